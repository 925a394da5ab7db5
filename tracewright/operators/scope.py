"""Scope and sections: FLT-19 to FLT-23, JOIN-14 to JOIN-16, AGG-01 to AGG-03, AGG-29, TOP-12, SET-05."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.paths import in_entry, in_scope, is_test_node
from ..storage import dealt
from .ranked import top_k
from .traverse import without_end


def scope_frame(spark, entries: list[str]) -> DataFrame:
    """pos and prefix; a repeated entry counts at its first place."""
    return spark.createDataFrame([(i, p) for i, p in enumerate(dict.fromkeys(entries))], "pos int, prefix string")


def filter_to_scope(nodes: DataFrame, edges: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """FLT-20: nodes in scope, edges with both ends among them. Without a scope everything stays, dangling edges too."""
    if not scope:
        return nodes, edges
    kept = nodes.filter(in_scope("file", scope))
    ids = kept.select("id").distinct()
    return kept, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def with_section(df: DataFrame, entries: list[str], file: str = "file") -> DataFrame:
    """JOIN-14, JOIN-15: the longest entry that holds the file; null for none. The entries are one expression of
    the plan, longest first, so rows meet no join."""
    found = F.coalesce(*[F.when(in_entry(file, F.lit(p)), F.lit(p)) for p in sorted(dict.fromkeys(entries), key=lambda p: (-len(p), p))]) if entries else F.lit(None).cast("string")
    return df.withColumn("section", found)


def section_argument(section: str | None, entries: list[str]) -> str:
    """FLT-22: all, section or unknown-section."""
    return "all" if section is None else "section" if section in entries else "unknown-section"


def section_states(section: Column, entries: list[str]) -> Column:
    """FLT-22 for a column of arguments: all (null), section or unknown-section."""
    return F.when(section.isNull(), "all").when(section.isin(entries), "section").otherwise("unknown-section")


def filter_to_section(nodes: DataFrame, edges: DataFrame, entries: list[str], section: str) -> tuple[DataFrame, DataFrame]:
    """FLT-21."""
    kept = with_section(nodes, entries).filter(F.col("section") == section).drop("section")
    ids = kept.select("id").distinct()
    return kept, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def exclude_tests(nodes: DataFrame, edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """FLT-23: production nodes, and edges that touch no id which only test nodes carry. rows: see traverse.with_end()."""
    marked = nodes.withColumn("_test", is_test_node())
    only = dealt(marked.select("id", "_test"), rows, "id").groupBy("id").agg(F.min("_test").alias("t")).filter("t").select("id")
    return marked.filter("NOT _test").drop("_test"), without_end(without_end(edges, only, "src", rows), only, "dst", rows)


def section_counts(nodes: DataFrame, entries: list[str]) -> DataFrame:
    """AGG-01: pos, section and nodes in the entries' order, zeros kept."""
    counts = with_section(nodes, entries).filter("section IS NOT NULL").groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    return scope_frame(nodes.sparkSession, entries).withColumnRenamed("prefix", "section").join(counts, "section", "left").select("pos", "section", F.coalesce("n", F.lit(0).cast("long")).alias("nodes"))


def section_tabs(counts: DataFrame) -> DataFrame:
    """AGG-29: the sum of all ahead of the sections."""
    whole = counts.agg(F.coalesce(F.sum("nodes"), F.lit(0).cast("long")).alias("nodes")).select(F.lit(-1).alias("pos"), F.lit("all").alias("section"), "nodes")
    return whole.unionByName(counts)


def _ends(nodes: DataFrame, edges: DataFrame, entries: list[str]) -> DataFrame:
    of = with_section(nodes, entries).select("id", "section").dropDuplicates(["id"])
    a, b = of.select(F.col("id").alias("src"), F.col("section").alias("src_section")), of.select(F.col("id").alias("dst"), F.col("section").alias("dst_section"))
    return edges.join(a, "src").join(b, "dst").filter("src_section IS NOT NULL AND dst_section IS NOT NULL AND src_section != dst_section")


def cross_section_edges(nodes: DataFrame, edges: DataFrame, entries: list[str]) -> DataFrame:
    """AGG-02, TOP-12: for each section, edges out to and in from each other one; all kinds, duplicates counted."""
    e = _ends(nodes, edges, entries)
    ways = e.select(F.col("src_section").alias("section"), F.col("dst_section").alias("other"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("dst_section").alias("section"), F.col("src_section").alias("other"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ways.groupBy("section", "other").agg(F.sum("out").alias("outgoing"), F.sum("in").alias("incoming")).orderBy("section", F.desc(F.col("outgoing") + F.col("incoming")), "other")


def cross_section_calls(nodes: DataFrame, edges: DataFrame, entries: list[str]) -> DataFrame:
    """JOIN-16: of each node, the callees in other sections, each once, CROSS_SECTION_MAX shown by section, name and id."""
    e = _ends(nodes, edges.filter("kind = 'CALLS'"), entries).select(F.col("src").alias("id"), F.col("dst").alias("callee"), F.col("dst_section").alias("section")).distinct()
    names = nodes.select(F.col("id").alias("callee"), "name").dropDuplicates(["callee"])
    return top_k(e.join(names, "callee"), ["id"], ["section", "name", "callee"], S.CROSS_SECTION_MAX)


def changed_elsewhere(measures: dict[str, DataFrame], entries: list[str], section: str) -> DataFrame:
    """AGG-03: for each other section how many of each measure (frames with a file each) fall into it; all-zero rows go."""
    rows = None
    for name, df in measures.items():
        one = with_section(df, entries).filter(F.col("section") != section).select("section", *[F.lit(int(n == name)).alias(n) for n in measures])
        rows = one if rows is None else rows.unionByName(one)
    out = rows.groupBy("section").agg(*[F.sum(n).alias(n) for n in measures])
    return out.orderBy(F.desc(sum((F.col(n) for n in measures), F.lit(0))), "section")


def same_scopes(a: Column, b: Column) -> Column:
    """SET-05 for columns of lists: the same entries in the same order; two nulls are the same."""
    return a.eqNullSafe(b)
