"""What a change touches: JOIN-02 to JOIN-07, AGG-04, JOIN-17, JOIN-18, JOIN-21, AGG-28.

Changed lines are two frames: listed (files whose ranges are known, maybe none) and ranges (file,
start, end). So a file with no ranges and a file not known stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import contained, mapped_severity
from ..storage import apart, dealt


def changed_nodes(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """JOIN-02."""
    return nodes.join(changed.select("file").distinct(), "file", "left_semi").select("id").distinct()


def top_level_only(nodes: DataFrame, modules: DataFrame, changed: DataFrame) -> DataFrame:
    """JOIN-03: changed files with folded top-level content and no node, in the order of the change."""
    files = changed.groupBy("file").agg(F.min("ord").alias("ord")).join(modules.select("file").distinct(), "file", "left_semi")
    return files.join(nodes.select("file").distinct(), "file", "left_anti").orderBy("ord")


def _around(nodes: DataFrame, points: DataFrame, rows: int | None) -> DataFrame:
    """points with _node: id, start_line and end_line of the smallest node around each, the first of equals by ord.

    Nodes of one range count once and so do points of one line, so a file's ranges meet its lines, not each node each
    point. rows: how many nodes or points there are at most, for dealt()."""
    each = nodes.select("file", "start_line", "end_line", F.col("id").alias("node_id"), F.col("ord").alias("_ord"))
    first = dealt(each, rows, "file", "start_line", "end_line").groupBy("file", "start_line", "end_line").agg(F.min_by(F.struct("node_id", "_ord"), F.struct("_ord")).alias("_first"))
    at = points.select("file", "line").distinct().join(first, "file").filter("line BETWEEN start_line AND end_line")
    order = F.struct((F.col("end_line") - F.col("start_line")).alias("size"), F.col("_first._ord"))
    best = at.groupBy("file", "line").agg(F.min_by(F.struct("_first.node_id", "start_line", "end_line"), order).alias("_node"))
    return points.join(best if rows is None else apart(dealt(best, rows, "file", "line")), ["file", "line"]).select(*points.columns, "_node")


def enclosing(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """JOIN-04, JOIN-17, JOIN-18: points (file, line and more) with node_id of the smallest node around them, the first
    of equals by ord; points outside every node go."""
    return _around(nodes, points, None).select(*points.columns, "_node.node_id")


def findings_of_nodes(nodes: DataFrame, findings: DataFrame, tool: str, severity: str | None = None, rows: int | None = None) -> DataFrame:
    """JOIN-17; with one severity for all, JOIN-18. Each finding takes its node's range. rows: how many nodes or findings there are at most."""
    level = mapped_severity("severity") if severity is None else F.lit(severity)
    return _around(nodes, findings, rows).select("_node.node_id", F.lit(tool).alias("tool"), level.alias("severity"), F.col("message").alias("finding"), "file", "_node.start_line", "_node.end_line", "point")


def replace_tool(old: DataFrame, new: DataFrame, tool: str) -> DataFrame:
    """AGG-28."""
    return old.filter(F.col("tool") != tool).unionByName(new)


def changed_contracts(types: DataFrame, used_by: DataFrame, changed: DataFrame, listed: DataFrame, ranges: DataFrame, map_ids: DataFrame | None = None) -> DataFrame:
    """JOIN-05, JOIN-06, TOP-04: id, name, kind, file, approximate, dependents, dependent_ids (DEPENDENTS_MAX at most, sorted).

    A type counts if a range of its file touches its lines; in a changed file whose lines aren't
    known every type counts, approximately."""
    here = types.dropDuplicates(["id"]).join(changed.select("file").distinct(), "file", "left_semi")
    known = here.join(listed.select("file").distinct(), "file", "left_semi")
    touched = known.join(ranges.select("file", "start", "end").distinct(), "file").filter("start <= end_line AND start_line <= end").select(*here.columns).distinct()
    unknown = here.join(listed.select("file").distinct(), "file", "left_anti")
    rows = touched.withColumn("approximate", F.lit(False)).unionByName(unknown.withColumn("approximate", F.lit(True)))
    users = used_by.select(F.col("type").alias("id"), F.col("id").alias("user")).distinct()
    if map_ids is not None:
        users = users.join(map_ids.select(F.col("id").alias("user")).distinct(), "user", "left_semi")
    # a type may have very many users: count them all, gather the first few
    rank = F.row_number().over(Window.partitionBy("id").orderBy("user"))
    users = users.join(rows.select("id"), "id", "left_semi")
    few = users.withColumn("r", rank).filter(F.col("r") <= S.DEPENDENTS_MAX).groupBy("id").agg(F.array_sort(F.collect_list("user")).alias("dependent_ids"))
    total = users.groupBy("id").agg(F.count(F.lit(1)).alias("dependents"))
    out = rows.join(total, "id", "left").join(few, "id", "left")
    return out.select("id", "name", "kind", "file", "approximate", F.coalesce("dependents", F.lit(0).cast("long")).alias("dependents"), F.coalesce("dependent_ids", F.array().cast("array<string>")).alias("dependent_ids"))


def contract_only(types: DataFrame, ranges: DataFrame) -> DataFrame:
    """JOIN-07: files with ranges, each of which lies inside some type."""
    r = ranges.select("file", "start", "end").distinct()
    inside = r.join(types.select("file", "start_line", "end_line").distinct(), "file").filter(contained("start", "end", "start_line", "end_line")).select("file", "start", "end").distinct()
    out = r.join(inside, ["file", "start", "end"], "left_anti").select("file").distinct()
    return r.select("file").distinct().join(out, "file", "left_anti")


def contract_dependents(contracts: DataFrame, changed_ids: DataFrame) -> DataFrame:
    """JOIN-21: id of a dependent that didn't change itself, and the names of the contracts it depends on."""
    each = contracts.select(F.explode("dependent_ids").alias("id"), "name")
    return each.join(changed_ids.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("contracts"))


def summary(nodes: DataFrame, types: DataFrame, used_by: DataFrame, modules: DataFrame, changed: DataFrame, listed: DataFrame, ranges: DataFrame) -> dict[str, DataFrame]:
    """AGG-04."""
    return {"nodes": changed_nodes(nodes, changed), "contracts": changed_contracts(types, used_by, changed, listed, ranges, nodes), "contract_only": contract_only(types, ranges), "top_level": top_level_only(nodes, modules, changed)}
