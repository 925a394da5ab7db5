"""The review table: AGG-20 to AGG-25, TOP-08, TOP-09, FLT-27, FLT-28, JOIN-22, JOIN-31, SET-03."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..storage import apart
from .ranked import top_k
from .risk import severity_rank


def default_order() -> list[Column]:
    """TOP-08: changed first, then nearer, then the larger blast radius, then by id."""
    return [F.coalesce("hop", F.lit(0)).asc(), F.coalesce("blast_radius", F.lit(-1)).desc(), F.col("id").asc()]


def rows(nodes: DataFrame, changed: DataFrame, hops: DataFrame, depth: int) -> DataFrame:
    """AGG-20, FLT-27: nodes changed (all, hop null) and affected within depth (the first REVIEW_AFFECTED_MAX), with
    hidden, how many affected ones were cut off. nodes: id, name and measures."""
    own = nodes.join(changed.select("id").distinct(), "id", "left_semi").withColumn("hop", F.lit(None).cast("int"))
    near = nodes.join(hops.filter(F.col("hop") <= depth).select("id", "hop").distinct(), "id").join(changed.select("id").distinct(), "id", "left_anti")
    top = top_k(near, [], default_order(), S.REVIEW_AFFECTED_MAX, "_rank", "_all").drop("_rank", "_all")
    hidden = near.agg(F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - S.REVIEW_AFFECTED_MAX).alias("hidden"))
    return own.unionByName(top.select(*own.columns)).crossJoin(F.broadcast(hidden))


def missing(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """SET-03, JOIN-30: ids that are not on the map."""
    return ids.select("id").distinct().join(nodes.select("id").distinct(), "id", "left_anti")


def findings_summary(findings: DataFrame) -> DataFrame:
    """AGG-21: id, findings, worst severity and the tool of the first of that severity. findings: node_id, tool, severity, ord."""
    return findings.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("findings"), F.min_by("severity", F.struct(severity_rank("severity"), "ord")).alias("severity"), F.min_by("tool", F.struct(severity_rank("severity"), "ord")).alias("tool"))


def bars(table: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-22: each column's share of its largest value in percent, two decimals, as bar_<column>; null stays null."""
    most = table.agg(*[F.max(c).alias(f"_max_{c}") for c in columns])
    out = table.crossJoin(F.broadcast(most))
    for c in columns:
        top = F.col(f"_max_{c}")
        out = out.withColumn(f"bar_{c}", F.when(F.col(c).isNotNull(), F.when(top > 0, F.round(F.least(F.greatest(F.col(c), F.lit(0)), top) / top * 100, 2)).otherwise(F.lit(0.0))))
    return out.drop(*[f"_max_{c}" for c in columns])


def tests_state(gap: Column, hit: Column, tests: Column, known: Column) -> Column:
    """AGG-23: gap, covered, unproven or none."""
    return F.when(gap, "gap").when(hit | (tests > 0), "covered").when(known, "unproven").otherwise("none")


def first_depth(hops: DataFrame, *keys: str) -> DataFrame:
    """AGG-24: the largest hop, and the depth to begin with: 1 or 2; with keys, of each group."""
    return hops.groupBy(*keys).agg(F.max("hop").alias("max_hop")).select(*keys, "max_hop", F.greatest(F.lit(1), F.least(F.lit(2), F.coalesce("max_hop", F.lit(1)))).alias("depth"))


def column_order(column: str, descending: bool = False, text: bool = False) -> list[Column]:
    """TOP-09: by one column, nulls last either way, text without case and accents; ties by id upwards."""
    key = F.collate(F.col(column), "UNICODE_CI_AI") if text else F.col(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("id").asc()]


def sorted_by(table: DataFrame, column: str, descending: bool = False, text: bool = False) -> DataFrame:
    """TOP-09: the rows in that order; order.places() numbers them."""
    return table.orderBy(*column_order(column, descending, text))


def calls_only(edges: DataFrame) -> DataFrame:
    """FLT-28."""
    return edges.filter("kind = 'CALLS'").select("src", "dst")


def changed_in_clusters(members: DataFrame, changed: DataFrame) -> DataFrame:
    """AGG-25: cluster and changed members. members: cluster, id."""
    hit = members.join(changed.select("id").distinct(), "id", "left_semi").groupBy("cluster").agg(F.count_distinct("id").alias("n"))
    return members.select("cluster").distinct().join(hit, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0).cast("long")).alias("changed"))


def cluster_edges(edges: DataFrame, changed: DataFrame, cluster_of: DataFrame, visible: DataFrame) -> DataFrame:
    """JOIN-22: edges with a changed end, moved to what is drawn: the end's cluster, else the end where it is visible."""
    # one table tells where a node is drawn and whether it changed, so edges are dealt once for each end
    clusters = cluster_of.select("id", F.col("cluster").alias("at")).filter("at IS NOT NULL")
    place = clusters.unionByName(visible.select("id").distinct().join(clusters.select("id"), "id", "left_anti").withColumn("at", F.col("id")))
    place = apart(place.join(changed.select("id", F.lit(True).alias("new")).distinct(), "id", "left"))
    of = lambda end: place.select(F.col("id").alias(end), F.col("at").alias(f"{end}_at"), F.col("new").alias(f"{end}_new"))
    near = edges.join(of("src"), "src").distinct().join(of("dst"), "dst")
    drawn = near.filter("coalesce(src_new, dst_new) AND src_at != dst_at")
    return drawn.groupBy(F.col("src_at").alias("src"), F.col("dst_at").alias("dst")).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("kind").alias("kinds"))


def drawn_edges(edges: DataFrame, visible: DataFrame, regrouped: DataFrame, highlighted: DataFrame) -> DataFrame:
    """JOIN-31: edges between visible cards, and the regrouped ones, each with whether an end is highlighted."""
    ids = visible.select("id").distinct()
    plain = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    both = plain.withColumn("regrouped", F.lit(False)).unionByName(regrouped.select("src", "dst", F.lit(True).alias("regrouped")))
    lit = highlighted.select("id", F.lit(True).alias("on")).distinct()
    both = both.join(lit.select(F.col("id").alias("src"), F.col("on").alias("a")), "src", "left").join(lit.select(F.col("id").alias("dst"), F.col("on").alias("b")), "dst", "left")
    return both.select("src", "dst", "regrouped", F.coalesce("a", "b", F.lit(False)).alias("highlight"))
