"""Euler tours of trees: TRV-18."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fresh, hadoop_path, written
from .order import places


def _ranked(links: DataFrame) -> DataFrame:
    """links (e, back, w, d) with w and d summed from each list's first event up to e, back null.

    Pointer doubling: in each round an event takes over the sums of the event it points back to and
    points where that one pointed, so n events take about log2(n) rounds, however deep the tree. Each
    round is a table, which goes once the next one is written.
    """
    spark, path = links.sparkSession, fresh(links.sparkSession, "tour")
    links.write.parquet(path)
    read = spark.read.schema(links.schema).parquet
    for _ in range(read(path).count().bit_length() + 1):
        links = read(path)
        going = links.filter("back IS NOT NULL")
        if going.isEmpty():
            return links
        other = links.select(F.col("e").alias("back"), F.col("back").alias("further"), F.col("w").alias("w2"), F.col("d").alias("d2"))
        ahead = going.join(other, "back").select("e", F.col("further").alias("back"), (F.col("w") + F.col("w2")).alias("w"), (F.col("d") + F.col("d2")).alias("d"))
        # finished events meet no join: their null keys would all go to one task
        links.filter("back IS NULL").unionByName(ahead).write.parquet(after := fresh(spark, "tour"))
        file, store = hadoop_path(spark, path)
        store.delete(file, True)
        path = after
    raise ValueError("not a tree: a row is its own ancestor")


def preorder(tree: DataFrame) -> DataFrame:
    """TRV-18: rows of trees (root, id, parent) with depth (int, from 0), size (rows of the subtree, itself
    included) and ord (from 1 within each root); children stand by id below their parent.

    A row whose parent is null or isn't in the tree is a top row of its own; top rows of a root stand by id. Each
    (root, id) must be there once; a cycle is an error; no rows give none. A row is entered and left once each.
    Events point to the event before them: entering points to leaving the sibling before, or to entering
    the parent; leaving points to leaving the last child, or to entering. Counts of entries up to an
    event give ord and size, entries less leavings give depth.
    """
    known = tree.select("root", F.col("id").alias("parent"), F.lit(True).alias("known"))
    rows = tree.join(known, ["root", "parent"], "left").select("root", "id", F.when(F.col("known"), F.col("parent")).alias("parent"))
    at = written(places(rows, [F.col("root").asc(), F.col("parent").asc_nulls_first(), F.col("id").asc()]), "tour-places")
    above = at.select("root", F.col("id").alias("parent"), F.col("place").alias("up"))
    at = written(at.join(above, ["root", "parent"], "left"), "tour-parents")

    def beside(by: int, name: str) -> DataFrame:
        return at.select((F.col("place") - by).alias("place"), F.struct("root", "up").alias(name))

    mine = F.struct("root", "up")
    near = at.join(beside(1, "next"), "place", "left").join(beside(-1, "prev"), "place", "left")
    near = written(near.select("place", "root", "id", "parent", "up", (~mine.eqNullSafe(F.col("next"))).alias("last"), (~mine.eqNullSafe(F.col("prev"))).alias("first")), "tour-siblings")
    lasts = near.filter("last AND up IS NOT NULL").select(F.col("up").alias("place"), F.col("place").alias("child"))
    entered, left = F.col("place") * 2, F.col("place") * 2 + 1
    one = F.lit(1).cast("long")
    enter = near.select(entered.alias("e"), F.when(~F.col("first"), left - 2).otherwise(F.col("up") * 2).alias("back"), one.alias("w"), one.alias("d"))
    leave = near.join(lasts, "place", "left").select(left.alias("e"), F.coalesce(F.col("child") * 2 + 1, entered).alias("back"), (one - 1).alias("w"), (-one).alias("d"))
    ranked = _ranked(enter.unionByName(leave))
    of = lambda side, c: F.max(F.when(F.col("e") % 2 == side, F.col(c)))
    sums = ranked.groupBy(F.shiftright("e", 1).alias("place")).agg(of(0, "w").alias("ord"), of(1, "w").alias("until"), of(0, "d").alias("open"))
    return near.join(sums, "place").select("root", "id", "parent", (F.col("open") - 1).cast("int").alias("depth"), (F.col("until") - F.col("ord") + 1).alias("size"), "ord")
