"""A keyed record store as sorted runs that are merged on read: SNK-01, SNK-02, SRC-32, STR-12.

A batch adds one run of its own rows, so what is written grows with the batch and not with the store.
Runs of one level are merged into a run of the next level once there are enough of them, which writes
each record about once a level. A run is a folder L<level>-<first batch>-<last batch>; it counts once
its writer has finished it, and a run that lies within another finished one counts no more. A batch
that comes again finds its run and changes nothing.

Each field of a record keeps when it was set, so runs can be merged in any grouping: the later one by
(batch, seq) wins field by field, and a cleared field is a null with a time.
"""

from __future__ import annotations

import re
import threading
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..storage import hadoop_path

RUN = re.compile(r"L(\d+)-(\d+)-(\d+)")


class RecordStore:
    """Records by key at a path that driver and executors share. schema: DDL of the key and the fields."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, fan: int = 8, buckets: int = 16):
        self.spark, self.path, self.key, self.fan, self.buckets = spark, path.rstrip("/"), key, fan, buckets
        types = T.StructType.fromDDL(schema)
        self.fields = [f for f in types if f.name != key]
        self.schema = types
        held = [T.StructField(f.name, T.StructType([T.StructField("batch", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("v", f.dataType)])) for f in self.fields]
        self.run_schema = T.StructType([types[key], *held, T.StructField("bucket", T.IntegerType())])
        self._one_compaction = threading.Lock()

    def _listed(self) -> list[tuple[int, int, int]]:
        """(level, first, last) of the finished runs."""
        root, fs = hadoop_path(self.spark, self.path)
        if not fs.exists(root):
            return []
        found = []
        for s in fs.listStatus(root):
            if (m := RUN.fullmatch(s.getPath().getName())) and fs.exists(hadoop_path(self.spark, f"{s.getPath().toString()}/_SUCCESS")[0]):
                found.append(tuple(map(int, m.groups())))
        return found

    def runs(self) -> list[tuple[int, int, int]]:
        """Those that count, by first batch: none lies within another."""
        out: list[tuple[int, int, int]] = []
        for level, lo, hi in sorted(self._listed(), key=lambda r: (r[1], -r[2], -r[0])):
            if not out or hi > out[-1][2]:
                out.append((level, lo, hi))
        return out

    def _name(self, run: tuple[int, int, int]) -> str:
        return f"{self.path}/L{run[0]}-{run[1]}-{run[2]}"

    def _frames(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        frames = [self.spark.read.schema(self.run_schema).parquet(self._name(r)) for r in runs]
        return reduce(DataFrame.unionByName, frames, self.spark.createDataFrame([], self.run_schema))

    def _merged(self, held: DataFrame) -> DataFrame:
        """One row for each key, whatever the number of its rows: partial maxima before the shuffle."""
        latest = [F.max_by(F.col(f.name), F.when(F.col(f.name).isNotNull(), F.struct(F.col(f.name)["batch"], F.col(f.name)["seq"]))).alias(f.name) for f in self.fields]
        return held.groupBy(self.key).agg(*latest, F.first("bucket").alias("bucket"))

    def append(self, updates: DataFrame, batch: int) -> bool:
        """Write a batch's updates; False if the store has that batch. updates: the key, seq (a long; of equal ones any counts), the
        fields (null: not set) and perhaps cleared, an array of names of fields to empty. Rows without a key are left out."""
        if any(lo <= batch <= hi for _, lo, hi in self._listed()):
            return False
        cleared = F.coalesce(F.col("cleared"), F.array().cast("array<string>")) if "cleared" in updates.columns else F.array().cast("array<string>")

        def held(f):
            emptied = F.array_contains(cleared, f.name)
            return F.when(emptied | F.col(f.name).isNotNull(), F.struct(F.lit(batch).cast("long").alias("batch"), F.col("seq").cast("long").alias("seq"), F.when(~emptied, F.col(f.name)).cast(f.dataType).alias("v"))).alias(f.name)

        rows = updates.filter(F.col(self.key).isNotNull()).select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key), *[held(f) for f in self.fields], F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket"))
        self._merged(rows).write.mode("overwrite").parquet(self._name((0, batch, batch)))
        return True

    def read(self) -> DataFrame:
        """The merged view: a row for each key, of the fields' last values."""
        return self._merged(self._frames(self.runs())).select(*[self.key if f.name == self.key else F.col(f.name)["v"].alias(f.name) for f in self.schema])

    def lookup(self, keys: list) -> DataFrame:
        """The merged rows of a few keys; of merged runs only their buckets are read."""
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]]))
        at = [r[0] for r in asked.select(F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).distinct().collect()]
        rows = self._frames(self.runs()).filter(F.col("bucket").isin(at)).join(F.broadcast(asked), self.key, "left_semi")
        return self._merged(rows).select(*[self.key if f.name == self.key else F.col(f.name)["v"].alias(f.name) for f in self.schema])

    def _due(self) -> list[tuple[int, int, int]]:
        """Neighbouring runs of one level, enough for a merge; a missing batch number parts none (it had no rows)."""
        row: list[tuple[int, int, int]] = []
        for run in self.runs():
            row = [*row, run] if row and row[-1][0] == run[0] else [run]
            if len(row) == self.fan:
                return row
        return []

    def compact(self) -> int:
        """Merge runs until none is due; the number of merges. Readers and writers may go on meanwhile."""
        done = 0
        with self._one_compaction:
            while due := self._due():
                target = (due[0][0] + 1, due[0][1], due[-1][2])
                merged = self._merged(self._frames(due)).repartition("bucket").sortWithinPartitions("bucket", self.key)
                merged.write.mode("overwrite").partitionBy("bucket").parquet(self._name(target))
                done += 1
        return done

    def vacuum(self) -> int:
        """Delete runs that count no more, once no reader has them open; their number."""
        kept, gone = set(self.runs()), 0
        for run in self._listed():
            if run not in kept:
                path, fs = hadoop_path(self.spark, self._name(run))
                gone += bool(fs.delete(path, True))
        return gone

    def sink(self, updates: DataFrame, checkpoint: str, trigger: str = "500 milliseconds", once: bool = False, background: bool = True) -> StreamingQuery:
        """Keep the store up to date with a stream of updates: a run for each batch, merges beside the stream or after each batch."""

        def write(rows: DataFrame, number: int) -> None:
            self.append(rows, number)
            if background:
                if not self._one_compaction.locked() and self._due():
                    threading.Thread(target=self.compact, daemon=True).start()
            else:
                self.compact()

        w = updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime=trigger)).start()
