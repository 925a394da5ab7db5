"""Places in the total order of a whole table, without one task that sees it all: TOP-09, FN-01."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import counted, written

#: monotonically_increasing_id() counts a partition's rows in these bits.
WITHIN = (1 << 33) - 1


def places(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with each row's place (a long, from 1) in the order of all rows.

    Rows are dealt by ranges of the order, so a partition's rows stand together; a place is one within
    the partition and the sizes of those before it, of which there is one row for each partition.
    Rows that are equal in the order have places in any order of theirs. No rows give none.
    """
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    rows = written(dealt.select(*[F.col(c) for c in df.columns], F.shiftright("at", 33).alias("_part"), (F.col("at").bitwiseAND(WITHIN) + 1).alias("_within")), "placed")
    sizes = rows.groupBy("_part").agg(F.max("_within").alias("n")).orderBy("_part").collect()
    starts = [0, *accumulate(r["n"] for r in sizes)][: len(sizes)]
    before = df.sparkSession.createDataFrame([(r["_part"], n) for r, n in zip(sizes, starts, strict=True)], "_part long, _before long")
    return rows.join(F.broadcast(before), "_part").select(*[F.col(c) for c in df.columns], (F.col("_before") + F.col("_within")).alias(name))


def numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """id and number, from 0 without gaps, of each distinct id; and how many they are."""
    at = F.monotonically_increasing_id()
    rows, n = counted(ids.select("id").distinct().select("id", at.alias("at")), "ids")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each partition
    starts = [0, *accumulate(r["n"] for r in sizes)][: len(sizes)]
    before = F.create_map(*[F.lit(x) for r, start in zip(sizes, starts, strict=True) for x in (r["part"], start)]) if sizes else F.create_map().cast("map<bigint,int>")
    return rows.select("id", (F.element_at(before, part) + F.col("at").bitwiseAND(WITHIN)).cast("long").alias("number")), n
