"""Links attached to nodes: JOIN-01, JOIN-11 to JOIN-13, FLT-16 to FLT-18, TOP-01 to TOP-03, TOP-13."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.paths import base_name, is_evidence_source, is_test_node
from .ranked import first_of, symmetric, top_k


def hotspots(nodes: DataFrame, files: DataFrame, exclude: Column | None = None) -> DataFrame:
    """JOIN-01: nodes with hotspot, the change count of their file's last row; null for excluded files and those without one."""
    files = files.filter(~exclude) if exclude is not None else files
    last = files.groupBy("file").agg(F.max_by("change_count", "ord").alias("hotspot"))
    return nodes.join(last, "file", "left").select(*nodes.columns, "hotspot")


def import_resolved(strategy: str = "strategy", confidence: str = "confidence") -> Column:
    """FLT-16."""
    return F.col(strategy).isin(*S.EVIDENCE_STRATEGIES) & F.coalesce(F.col(confidence) >= S.EVIDENCE_CONFIDENCE, F.lit(False))


def strong_co_change(n: str = "co_changes", score: str = "score") -> Column:
    """FLT-17; NaN and null fail."""
    return (F.col(n) >= S.CO_CHANGE_MIN) & (F.col(score) >= S.CO_CHANGE_SCORE) & (F.col(score) <= 1)


def similar_enough(score: str = "score") -> Column:
    """FLT-18."""
    return (F.col(score) >= S.SIMILAR_SCORE) & (F.col(score) <= 1)


def tested_by(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """JOIN-11, TOP-03, TOP-13: id and its tests (test, name, file, start_line, end_line, top_level), ranked, with the total.

    A test's call counts when it was resolved by an import, its source is a test and no production
    id, and its target is a production id and no test's. One row for each target and source: a row
    that knows its line before one that doesn't, then the earlier line. A module opens at the call.
    """
    marked = nodes.select("id", is_test_node().alias("t"))
    prod, test = marked.filter("NOT t").select("id").distinct(), marked.filter("t").select("id").distinct()
    good = calls.filter(import_resolved() & is_evidence_source("source_file", "source_is_test"))
    good = good.join(prod.withColumnRenamed("id", "source"), "source", "left_anti").join(prod.withColumnRenamed("id", "target"), "target", "left_semi").join(test.withColumnRenamed("id", "target"), "target", "left_anti")
    module = F.col("source_kind") == "Module"
    start = F.when(module, F.coalesce("line", "source_start")).otherwise(F.col("source_start"))
    rows = good.select(
        F.col("target").alias("id"),
        F.col("source").alias("test"),
        F.when(module, base_name("source_file")).otherwise(F.col("source_name")).alias("name"),
        F.col("source_file").alias("file"),
        start.alias("start_line"),
        F.when(module, start).otherwise(F.col("source_end")).alias("end_line"),
        module.alias("top_level"),
        (module & F.col("line").isNull()).alias("no_line"),
        "ord",
    )
    best = first_of(rows, ["id", "test"], ["no_line", "start_line", "ord"])
    return top_k(best.drop("no_line", "ord"), ["id"], ["file", "start_line", "test"], S.TESTED_BY_MAX)


def test_files(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """JOIN-11, by file: production file and test_file, with the range of the first module row of the test file.

    nodes need ord for "first"."""
    good = links.filter(is_evidence_source("test_file", F.lit(False)) & ~is_test_node("file", F.lit(False))).distinct()
    ranges = first_of(nodes.filter(is_test_node() & (F.col("kind") == "Module")).select(F.col("file").alias("test_file"), "start_line", "end_line", "ord"), ["test_file"], ["ord"]).drop("ord")
    return good.join(ranges, "test_file", "left").select("file", "test_file", "start_line", "end_line")


def similar(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """JOIN-12, TOP-02: id and its most similar functions of other files, ranked, with the total.

    Both ends are functions that are no tests and whose id no other node has; of repeated pairs the
    highest score counts."""
    once = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("kind").alias("kind"), F.first("name").alias("name"), F.first("file").alias("file"), F.max(is_test_node()).alias("t"))
    able = once.filter("n = 1 AND kind = 'Function' AND NOT t").select("id", "name", "file")
    good = symmetric(pairs.filter(similar_enough() & (F.col("a") != F.col("b"))).select("a", "b", "score"), "a", "b").groupBy("a", "b").agg(F.max("score").alias("score"))
    both = good.join(able.select(F.col("id").alias("a"), F.col("file").alias("_file")), "a").join(able.withColumnRenamed("id", "b"), "b").filter("_file != file")
    return top_k(both.select(F.col("a").alias("id"), F.col("b").alias("other"), "name", "file", "score"), ["id"], [F.desc("score"), "name", "file", "other"], S.SIMILAR_MAX)


def similar_by_size(nodes: DataFrame, sized: DataFrame, score: Callable[[Column], Column], farthest: int) -> DataFrame:
    """JOIN-12, TOP-02 where the pairs are those of one group and their score falls with the difference of two whole sizes: what
    similar() gives for all pairs, without forming them.

    sized: id, group and size; score: of a difference; farthest: the largest difference that is similar enough.
    Members of one group, size and file have the same functions of other files to choose from. Of a
    list in order, the file itself takes away rows; so with SIMILAR_MAX rows of each file at most, its
    first 2 * SIMILAR_MAX hold what any file is shown. Totals are grouped counts.
    """
    k = S.SIMILAR_MAX
    once = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("kind").alias("kind"), F.first("name").alias("name"), F.first("file").alias("file"), F.max(is_test_node()).alias("t"))
    able = once.filter("n = 1 AND kind = 'Function' AND NOT t").join(sized, "id").select("id", "name", "file", "group", "size")
    places = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("off", "name", "file", "other"))
    offs = [F.lit(i).cast("long") for i in range(-farthest, farthest + 1)]
    near = lambda df: df.select(*[c for c in df.columns if c != "size"], F.explode(F.array(*offs)).alias("step"), "size").select("*", F.abs("step").alias("off"), (F.col("size") + F.col("step")).alias("at")).filter(score(F.col("off")) >= S.SIMILAR_SCORE).drop("step", "size")
    # the first rows of a group, size and file, then of what stands near a size
    own = able.withColumnsRenamed({"id": "other"}).withColumn("off", F.lit(0)).withColumn("p", places(["group", "size", "file"])).filter(F.col("p") <= k).drop("p", "off")
    line = near(own).withColumn("p", places(["group", "at", "file"])).filter(F.col("p") <= k).withColumn("p", places(["group", "at"])).filter(F.col("p") <= 2 * k).drop("p")
    # of each file that has a function of a size, what it is shown and how many there are
    kinds = able.groupBy("group", "size", "file").agg(F.count(F.lit(1)).alias("c"))
    own_count = near(kinds).groupBy("group", F.col("at").alias("size"), "file").agg(F.sum("c").alias("own"))
    all_count = near(kinds.groupBy("group", "size").agg(F.sum("c").alias("c"))).groupBy("group", F.col("at").alias("size")).agg(F.sum("c").alias("all"))
    told = kinds.join(own_count, ["group", "size", "file"]).join(all_count, ["group", "size"]).select("group", "size", F.col("file").alias("_file"), (F.col("all") - F.col("own")).alias("total"))
    shown = told.join(line.withColumnRenamed("at", "size"), ["group", "size"]).filter("_file != file")
    rank = F.row_number().over(Window.partitionBy("group", "size", "_file").orderBy("off", "name", "file", "other")).cast("long")
    shown = shown.withColumn("rank", rank).filter(F.col("rank") <= k)
    ids = able.select("id", "group", "size", F.col("file").alias("_file"))
    return ids.join(shown, ["group", "size", "_file"]).select("id", "other", "name", "file", score(F.col("off")).alias("score"), "rank", "total")


def co_changes(pairs: DataFrame) -> DataFrame:
    """JOIN-13, TOP-01: file and its partners, ranked, with the total. Of repeated pairs the one with more commits counts, the first of equals."""
    good = symmetric(pairs.filter(strong_co_change() & (F.col("file") != F.col("partner"))), "file", "partner")
    best = first_of(good, ["file", "partner"], [-F.col("co_changes"), F.col("ord")])
    return top_k(best.drop("ord"), ["file"], [F.desc("co_changes"), F.desc("score"), "partner"], S.CO_CHANGE_MAX)


def co_changes_of_nodes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """JOIN-13: every node with its file's partners."""
    return nodes.select("id", "file").join(co_changes(pairs), "file")
