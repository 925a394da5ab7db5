"""Scans of graph tables with row checks: SRC-01 to SRC-08, SRC-33, FLT-01 to FLT-05, FLT-30.

A row that lacks a needed value is dropped; rejects() counts them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.paths import flag, line_number, signal_value
from ..operators.links import similar_enough


def _text(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def node_rows(raw: DataFrame) -> DataFrame:
    """FLT-01, SRC-01: nodes with typed columns; built-ins, whose file starts with <, go."""
    typed = raw.filter(~F.startswith("file", F.lit("<"))).select("id", "name", "file", line_number("start_line").cast("int").alias("start_line"), line_number("end_line").cast("int").alias("end_line"), "kind", flag("is_test").alias("is_test"), signal_value("complexity").alias("complexity"), signal_value("cognitive").alias("cognitive"))
    return typed.filter(_text("id") & F.col("name").isNotNull() & _text("file") & F.col("start_line").isNotNull() & F.col("end_line").isNotNull() & F.col("kind").isin(*S.NODE_KINDS))


def edge_rows(raw: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """FLT-02, SRC-02: edges of known kinds with both ends; with nodes, only between them."""
    good = raw.select("src", "dst", "kind").filter(F.col("kind").isin(*S.EDGE_KINDS) & _text("src") & _text("dst"))
    if nodes is None:
        return good
    ids = nodes.select("id").distinct()
    return good.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def file_rows(raw: DataFrame) -> DataFrame:
    """FLT-03, SRC-03."""
    return raw.select("file", signal_value("change_count").cast("long").alias("change_count"), "ord").filter(_text("file") & F.col("change_count").isNotNull())


def test_calls(raw: DataFrame) -> DataFrame:
    """FLT-04, SRC-04: calls from test code with a strategy that counts; both predicates reach the scan."""
    near = F.coalesce(F.col("source_is_test"), F.lit(False)) | reduce(or_, [F.contains("source_file", F.lit(x)) for x in S.EVIDENCE_FRAGMENTS])
    return raw.filter(near & F.col("strategy").isin(*S.EVIDENCE_STRATEGIES) & _text("source") & _text("target") & _text("source_file"))


def test_files(edges: DataFrame) -> DataFrame:
    """SRC-05."""
    return edges.filter("kind = 'TESTS_FILE'").select(F.col("src").alias("test_file"), F.col("dst").alias("file")).filter(_text("test_file") & _text("file"))


def implements(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """SRC-06."""
    ids = nodes.filter(F.col("kind").isin("Interface", "Type")).select("id").distinct()
    rows = edges.filter("kind = 'IMPLEMENTS'").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return rows.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def similar_pairs(raw: DataFrame) -> DataFrame:
    """SRC-07, FLT-05: the floor reaches the scan."""
    return raw.filter(similar_enough() & _text("a") & _text("b"))


def co_change_pairs(raw: DataFrame) -> DataFrame:
    """SRC-08, FLT-05: no floor here: a missing score must not drop a row before it is looked at."""
    return raw.filter(_text("file") & _text("partner")).withColumn("score", F.coalesce("score", F.lit(0.0)))


def rejects(raw: DataFrame, good: DataFrame) -> DataFrame:
    """FLT-30: how many rows there were, and how many were dropped."""
    return raw.agg(F.count(F.lit(1)).alias("rows")).crossJoin(good.agg(F.count(F.lit(1)).alias("kept"))).select("rows", (F.col("rows") - F.col("kept")).alias("dropped"))


def gap_files(replies: DataFrame, column: str = "reply") -> DataFrame:
    """SRC-33: path and kind (skipped or partial) from an indexer's JSON reply; entries are strings or objects with a path."""
    v = F.try_parse_json(F.col(column))
    out = None
    for kind in ("skipped", "partial"):
        each = replies.select(F.explode(F.try_variant_get(v, f"$.{kind}", "array<variant>")).alias("x"))
        each = each.select(F.coalesce(F.try_variant_get("x", "$.path", "string"), F.when(F.schema_of_variant("x") == "STRING", F.try_variant_get("x", "$", "string"))).alias("path"), F.lit(kind).alias("kind")).filter("path IS NOT NULL")
        out = each if out is None else out.unionByName(each)
    return out
