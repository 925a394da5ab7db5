"""Work on streams: SNK-01, SNK-03 to SNK-05, STR-01 to STR-04, STR-08 to STR-12, STR-14, STR-16, STR-17, AGG-27, UDF-03.

There is no event time here: late work is told by a generation number, so no watermark is set.
Records are kept by store.py, requests and work under state by state.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .store import RecordStore

Work = Callable[[pd.Series], pd.DataFrame]


def current_only(results: DataFrame, generation: int) -> DataFrame:
    """STR-03, STR-04: results of a superseded generation are dropped."""
    return results.filter(F.col("generation") == generation)


def summarised(nodes: DataFrame, work: Work, generation: int) -> DataFrame:
    """STR-01, STR-02, UDF-03: id, kind (ok, degenerate or failed), text and generation for each node, urgent ones first.

    work maps a series of prompts to a frame of kind and text; a batch that raises is failed, not lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                out = work(pdf["prompt"]).reset_index(drop=True)
            except Exception as e:  # noqa: BLE001  the work is foreign code; its failure is a result
                out = pd.DataFrame({"kind": ["failed"] * len(pdf), "text": [str(e)] * len(pdf)})
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "kind": out["kind"].to_numpy(), "text": out["text"].to_numpy()})

    pending = nodes.sortWithinPartitions(F.desc("urgent"), "id").select("id", "prompt")
    return pending.mapInPandas(run, "id string, kind string, text string").withColumn("generation", F.lit(generation))


def degenerate_rate(outcomes: DataFrame, least: int = 5, rate: float = 0.3) -> DataFrame:
    """AGG-27: completed, degenerate and whether advice is due."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col("kind") == "degenerate")
    return outcomes.agg(n.alias("completed"), bad.alias("degenerate"), ((n >= least) & (bad >= n * F.lit(rate))).alias("advise"))


def latest(requests: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """STR-08, STR-14, STR-17: of each key the last request; earlier ones are superseded. force of any counts."""
    rest = [c for c in requests.columns if c not in (key, seq, "force")]
    return requests.groupBy(key).agg(F.max(seq).alias(seq), F.max("force").alias("force"), *[F.max_by(c, seq).alias(c) for c in rest])


def outcome(latest_good: DataFrame, replies: DataFrame) -> DataFrame:
    """STR-14: of each key the latest reply if it came out well, else the last good one kept."""
    last = replies.groupBy("key").agg(F.max_by(F.struct("ok", "value"), "request").alias("r"))
    return latest_good.join(last, "key", "full").select("key", F.when(F.col("r.ok"), F.col("r.value")).otherwise(F.col("value")).alias("value"))


class Cache:
    """STR-10, STR-11: persisted frames by generation and scope; a new generation lets go of all."""

    def __init__(self) -> None:
        self.generation, self.held = 0, {}

    def get(self, scope: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
        if scope not in self.held:
            self.held[scope] = make().persist()
        return self.held[scope]

    def renew(self) -> int:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()
        self.generation += 1
        return self.generation


def read_records(spark, path: str, schema: str) -> DataFrame:
    """SRC-32: the records of a store; empty if there is none. schema: DDL, the key first."""
    return RecordStore(spark, path, schema.split()[0], schema).read()


def record_sink(updates: DataFrame, path: str, key: str, schema: str, checkpoint: str, trigger: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """SNK-01, STR-12: updates into a keyed store, see RecordStore."""
    return RecordStore(updates.sparkSession, path, key, schema).sink(updates, checkpoint, trigger, once, background=not once)


def progress_sink(updates: DataFrame, show: Callable[[int, list], None], checkpoint: str, most: int = 5, once: bool = False) -> StreamingQuery:
    """SNK-04: hands on progress in batches of at most `most` rows, each second or sooner if the source is limited."""

    def hand_on(batch: DataFrame, number: int) -> None:
        rows = batch.orderBy("seq").toLocalIterator()
        held: list = []
        for r in rows:
            held.append(r)
            if len(held) == most:
                show(number, held)
                held = []
        if held:
            show(number, held)

    w = updates.writeStream.foreachBatch(hand_on).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()


def replies(df: DataFrame) -> DataFrame:
    """SNK-03: one JSON text a row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))


def append_log(entries: DataFrame, path: str) -> None:
    """SNK-05."""
    entries.write.mode("append").json(path)
