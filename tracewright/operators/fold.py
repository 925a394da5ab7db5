"""Folding modules and types out of the map: AGG-05 to AGG-11, TOP-05."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.paths import in_scope
from ..storage import apart, dealt
from .traverse import with_end, without_end


def _rank(kind: str = "kind"):
    out = F.lit(len(S.USE_KIND_RANK))
    for k, r in S.USE_KIND_RANK.items():
        out = F.when(F.col(kind) == k, r).otherwise(out)
    return out


def modules(nodes: DataFrame, edges: DataFrame, rows: int | None = None) -> dict[str, DataFrame]:
    """AGG-06: nodes and edges left on the map; modules (file, module_ids, start_line, end_line); uses (file, id, kind).

    A module whose id a map node has stays that node. A file uses a map node by its best kind.
    rows: see traverse.with_end().
    """
    kept = nodes.filter("kind != 'Module'")
    ids = apart(dealt(kept.select("id"), rows, "id").distinct())
    folded = nodes.filter("kind = 'Module'").join(ids, "id", "left_anti")
    of_file = folded.select("id", "file").distinct()
    files = folded.groupBy("file").agg(F.array_sort(F.collect_set("id")).alias("module_ids"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    gone = of_file.select("id")
    left = without_end(without_end(edges, gone, "src", rows), gone, "dst", rows)
    uses = edges.join(apart(dealt(of_file.withColumnRenamed("id", "src"), rows, "src")), "src")
    uses = with_end(uses, kept, "dst", rows)  # no id is both kept and gone
    uses = uses.groupBy("file", F.col("dst").alias("id")).agg(F.min_by("kind", _rank()).alias("kind"))
    return {"nodes": kept, "edges": left, "modules": files, "uses": uses}


def types(nodes: DataFrame, edges: DataFrame, implements: DataFrame, rows: int | None = None) -> dict[str, DataFrame]:
    """AGG-07: nodes and edges left on the map; types; used_by (type, id, kind of the user); refers (type, other); implements (type, other).

    Only USAGE edges into a type become uses. Each list holds a pair once; the mirrors are the same
    frames read the other way. rows: see traverse.with_end().
    """
    is_type = F.col("kind").isin("Interface", "Type")
    kept = nodes.filter(~is_type)
    kinds = dealt(kept.select("id", F.col("kind").alias("user_kind")), rows, "id").dropDuplicates(["id"])
    folded = nodes.filter(is_type).join(kinds.select("id"), "id", "left_anti").dropDuplicates(["id"])
    ids = folded.select("id")
    left = without_end(without_end(edges, ids, "src", rows), ids, "dst", rows)
    into = with_end(edges.filter("kind = 'USAGE' AND src != dst").select("src", "dst"), ids, "dst", rows).distinct()
    used = into.join(apart(dealt(kinds.withColumnRenamed("id", "src"), rows, "src")), "src").select(F.col("dst").alias("type"), F.col("src").alias("id"), F.col("user_kind").alias("kind"))
    refers = with_end(into, ids, "src", rows).select(F.col("src").alias("type"), F.col("dst").alias("other"))
    links = implements.filter("source != target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("type"), F.col("target").alias("other")).distinct()
    return {"nodes": kept, "edges": left, "types": folded, "used_by": used, "refers": refers, "implements": links}


def user_kinds(used_by: DataFrame) -> DataFrame:
    """AGG-05: type, kind, users; most users first, then by kind."""
    return used_by.groupBy("type", "kind").agg(F.count(F.lit(1)).alias("users")).orderBy("type", F.desc("users"), "kind")


def nested_types(f: dict[str, DataFrame], most: int = S.USED_BY_MAX_UI) -> DataFrame:
    """AGG-07, TOP-05: one row for each type with its lists sorted, used_by cut to `most` beside its total."""
    lists = lambda df, by, of, name: df.groupBy(F.col(by).alias("id")).agg(F.array_sort(F.collect_set(of)).alias(name))
    out = f["types"]
    for df, by, of, name in (
        (f["used_by"], "type", "id", "used_by"),
        (f["refers"], "type", "other", "refers_to"),
        (f["refers"], "other", "type", "referenced_by_types"),
        (f["implements"], "type", "other", "implements"),
        (f["implements"], "other", "type", "implemented_by"),
    ):
        out = out.join(lists(df, by, of, name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.withColumn("used_by_total", F.size("used_by")).withColumn("used_by", F.slice("used_by", 1, most))


def split_uses(uses: DataFrame, type_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-08: a file's uses of map nodes and of types."""
    return uses.join(type_ids, "id", "left_anti"), uses.join(type_ids, "id", "left_semi")


def rescoped(f: dict[str, DataFrame], nodes: DataFrame, scope: list[str]) -> dict[str, DataFrame]:
    """AGG-09: folded frames whose own file is in scope, with links to what is left on the map or among the types."""
    ids = nodes.select("id").distinct()
    out = dict(f)
    if "modules" in f:
        out["modules"] = f["modules"].filter(in_scope("file", scope))
        out["uses"] = f["uses"].filter(in_scope("file", scope)).join(ids, "id", "left_semi")
    if "types" in f:
        out["types"] = f["types"].filter(in_scope("file", scope))
        type_ids = out["types"].select(F.col("id").alias("type"))
        out["used_by"] = f["used_by"].join(type_ids, "type", "left_semi").join(ids, "id", "left_semi")
        for name in ("refers", "implements"):
            out[name] = f[name].join(type_ids, "type", "left_semi").join(type_ids.withColumnRenamed("type", "other"), "other", "left_semi")
    return out


def module_links(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """AGG-10: nodes with file_top_level (their file's uses) and called_at_load_by (files whose top level uses them)."""
    top = uses.groupBy("file").agg(F.array_sort(F.collect_set(F.struct(_rank().alias("rank"), "id", "kind"))).alias("file_top_level"))
    load = uses.groupBy("id").agg(F.array_sort(F.collect_set("file")).alias("called_at_load_by"))
    top = top.withColumn("file_top_level", F.transform("file_top_level", lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"))))
    return nodes.join(top, "file", "left").join(load, "id", "left")


def type_uses(nodes: DataFrame, f: dict[str, DataFrame]) -> DataFrame:
    """AGG-11: nodes with uses_types, by name and id."""
    names = f["types"].select(F.col("id").alias("type"), "name", F.col("kind").alias("type_kind"))
    uses = f["used_by"].select("type", "id").join(names, "type").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("name", F.col("type").alias("id"), F.col("type_kind").alias("kind")))).alias("uses_types"))
    return nodes.join(uses, "id", "left")
