"""The record store as keyed tables: SNK-02, JOIN-25 to JOIN-27, JOIN-32, STR-05 to STR-07, FLT-32."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_range


def merge(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """SNK-02: each field of new where it is there, else the old one; keys of both. A column cleared (array of field
    names, may be missing) in new sets fields to null."""
    clear = F.col("n.cleared") if "cleared" in new.columns else F.array().cast("array<string>")
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    value = lambda f: F.when(F.coalesce(F.array_contains(clear, f), F.lit(False)), F.lit(None)).otherwise(F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}"))).alias(f)
    return joined.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *[value(f) for f in fields])


def attach(nodes: DataFrame, gap_files: DataFrame, records: DataFrame) -> DataFrame:
    """JOIN-27: nodes with summary, stale and status: a gap beats a summary, a summary beats pending. records: id, summary, stale."""
    out = nodes.join(gap_files.select("file", F.lit(True).alias("_gap")).distinct(), "file", "left").join(records, "id", "left")
    status = F.when(F.col("_gap"), "coverage-gap").when(F.col("summary").isNotNull(), "summarized").otherwise("pending")
    return out.withColumn("status", status).drop("_gap")


def eligible(nodes: DataFrame, gap_files: DataFrame, done: DataFrame) -> DataFrame:
    """FLT-32."""
    return nodes.join(gap_files.select("file").distinct(), "file", "left_anti").join(done.select("id").distinct(), "id", "left_anti")


def baseline(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """STR-06: id, mtime, size and the hash of the node's lines. files: file, mtime, size, content."""
    return nodes.join(files, "file").select("id", "mtime", "size", F.sha2(source_range("content", "start_line", "end_line"), 256).alias("hash"))


def staleness(nodes: DataFrame, files: DataFrame, before: DataFrame) -> DataFrame:
    """STR-05: id and stale: false while the file has its time and size, or the lines their hash; null without a baseline
    or a readable file. before: id, mtime, size, hash."""
    now = nodes.select("id", "file", "start_line", "end_line").join(files, "file", "left").alias("n")
    out = now.join(before.select("id", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.col("hash").alias("h0")), "id", "left")
    same = (F.col("mtime") == F.col("m0")) & (F.col("size") == F.col("s0"))
    text = F.sha2(source_range("content", "start_line", "end_line"), 256)
    stale = F.when(F.col("h0").isNull() | F.col("mtime").isNull(), F.lit(None).cast("boolean")).when(same, False).otherwise(text.isNull() | (text != F.col("h0")))
    return out.select("id", stale.alias("stale"))


def head_drift(indexed: Column, current: Column) -> Column:
    """STR-07: both heads known and different."""
    return F.coalesce(indexed != current, F.lit(False))


def lookup(node_id: str, nodes: DataFrame, modules: DataFrame, types: DataFrame) -> DataFrame:
    """JOIN-25: found (node, module or type), id and file: the node of the id, else the folded module that holds it, else the folded type."""
    a = nodes.filter(F.col("id") == node_id).select(F.lit(0).alias("tier"), F.lit("node").alias("found"), "id", "file")
    b = modules.filter(F.array_contains("module_ids", node_id)).select(F.lit(1).alias("tier"), F.lit("module").alias("found"), F.lit(node_id).alias("id"), "file")
    c = types.filter(F.col("id") == node_id).select(F.lit(2).alias("tier"), F.lit("type").alias("found"), "id", "file")
    return a.unionByName(b).unionByName(c).orderBy("tier", "file").limit(1).drop("tier")


def patch(on_screen: DataFrame, again: DataFrame, fields: list[str]) -> DataFrame:
    """JOIN-32: the shown rows with these fields of the rows made again, where there are any."""
    new = again.select("id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_is"))
    out = on_screen.join(new, "id", "left")
    return out.select(*[F.when(F.col("_is"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in on_screen.columns])


def visible_history(snapshots: DataFrame) -> DataFrame:
    """STR-07 over a log of snapshots (project, at, head): rows where the head isn't that of the one before."""
    from pyspark.sql import Window

    before = F.lag("head").over(Window.partitionBy("project").orderBy("at"))
    return snapshots.withColumn("drift", head_drift(before, F.col("head")))
