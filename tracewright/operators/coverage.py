"""Line and function coverage of nodes: JOIN-08 to JOIN-10, AGG-31, SRC-19."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaps(nodes: DataFrame, listed: DataFrame, covered: DataFrame) -> DataFrame:
    """JOIN-08, JOIN-09: nodes with coverage_gap: their file is listed and none of their lines is covered.

    Null for files that aren't listed. A node that ends before it starts has no gap. The join is on the
    file; lines are compared within it, after each file's covered lines were made distinct.
    """
    lines = covered.select("file", "line").distinct()
    hit = nodes.select("id", "file", "start_line", "end_line").distinct().join(lines, "file").filter("line BETWEEN start_line AND end_line").select("id", "file", "start_line", "end_line").distinct().withColumn("_hit", F.lit(True))
    out = nodes.join(listed.select("file", F.lit(True).alias("_listed")).distinct(), "file", "left").join(hit, ["id", "file", "start_line", "end_line"], "left")
    gap = F.when(F.col("_listed"), F.col("_hit").isNull() & (F.col("start_line") <= F.col("end_line")))
    return out.withColumn("coverage_gap", gap).select(*nodes.columns, "coverage_gap")


def function_hits(nodes: DataFrame, functions: DataFrame, hits: DataFrame, stale: DataFrame) -> DataFrame:
    """JOIN-10: nodes with function_hit. functions: file, name, line; hits: file, name, hits; stale: file.

    A name known at several lines is ignored. A function at the node's first line decides; else any
    hit one inside does.
    """
    one = functions.groupBy("file", "name").agg(F.min("line").alias("line"), F.max("line").alias("other")).filter("line = other").drop("other")
    called = hits.groupBy("file", "name").agg(F.sum("hits").alias("hits"))
    known = one.join(called, ["file", "name"], "left").select("file", "line", F.coalesce(F.col("hits") > 0, F.lit(False)).alias("hit")).join(stale.select("file").distinct(), "file", "left_anti")
    key = ["id", "file", "start_line", "end_line"]
    inside = nodes.select(*key).distinct().filter("start_line >= 1 AND start_line <= end_line").join(known, "file").filter("line BETWEEN start_line AND end_line")
    told = inside.groupBy(*key).agg(F.max(F.when(F.col("line") == F.col("start_line"), F.col("hit"))).alias("exact"), F.max(F.when(F.col("line") > F.col("start_line"), F.col("hit"))).alias("inner_hit"))
    return nodes.join(told, key, "left").withColumn("function_hit", F.coalesce("exact", "inner_hit", F.lit(False))).select(*nodes.columns, "function_hit")


def stale_files(listed: DataFrame, modified: DataFrame, report_time: float) -> DataFrame:
    """SRC-19: listed files newer than the report or not readable. modified: file, mtime."""
    return listed.join(modified, "file", "left").filter(F.col("mtime").isNull() | (F.col("mtime") > report_time)).select("file")


def verdict(summary: DataFrame) -> DataFrame:
    """AGG-31: summary with has_gap."""
    return summary.withColumn("has_gap", (F.col("skipped") > 0) | (F.col("partial") > 0))
