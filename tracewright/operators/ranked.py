"""Top-k with the true total beside it, and the distinct that keeps what comes first (2.8, 2.9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank", total: str = "total") -> DataFrame:
    """The first k rows of each group in a total order, with rank from 1 and the group's size.

    The size is a grouped count, so a large group is ranked by a limit that Spark pushes below the
    exchange, not sorted whole for its count.
    """
    if not by:
        top = df.orderBy(*order).limit(k)
        return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(total))))
    top = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)
    return top.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias(total)), list(by))


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """SET-04, TOP-11, TOP-13: of each group the row that comes first; combined before the exchange."""
    rest = [c for c in df.columns if c not in by]
    key = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_row")).select(*by, "_row.*").select(*df.columns)


def symmetric(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """SET-06."""
    return pairs.unionByName(pairs.withColumns({a: F.col(b), b: F.col(a)}))


def recent(opened: DataFrame, path: str = "path", at: str = "opened_at", k: int = 10) -> DataFrame:
    """TOP-14: the last opening of each path, newest first, k of them."""
    return opened.groupBy(path).agg(F.max(at).alias(at)).orderBy(F.desc(at), path).limit(k)
