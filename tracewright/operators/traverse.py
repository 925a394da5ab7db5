"""Walks over directed edges (2.5). Edges have src, dst and kind; nodes have id.

Unbounded walks run level by level over edges that are written once. Each level is a join of the frontier
with the edges less what was visited, and is a table, so that plans stay short and a lost executor costs
no rerun of earlier levels. A small frontier is sent to the edges, which then aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..storage import LARGE, apart, counted, dealt, side, written_rows
from . import neighbourhood
from .tour import preorder  # noqa: F401  TRV-18


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once, where checkpoint() would work out its last stage twice."""
    return written_rows(df, "cut")


def with_end(edges: DataFrame, ids: DataFrame, end: str, rows: int | None) -> DataFrame:
    """edges whose end (a column) is among the ids. rows: how many edges and ids there are at most, for dealt().

    An inner join with each id once: a semi join would be pushed into each part of a union and dealt there."""
    return edges.join(apart(dealt(ids.select(F.col("id").alias(end)), rows, end).distinct()), end).select(*edges.columns)


def without_end(edges: DataFrame, ids: DataFrame, end: str, rows: int | None) -> DataFrame:
    """edges whose end isn't among the ids; see with_end()."""
    known = dealt(ids.select(F.col("id").alias(end)), rows, end).distinct().withColumn("_known", F.lit(True))
    return edges.join(apart(known), end, "left").filter("_known IS NULL").select(*edges.columns)


def valid_edges(nodes: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """JOIN-19, TRV-03: edges whose ends are both known; duplicates and self-loops stay. rows: see with_end()."""
    if rows is not None:
        return with_end(with_end(edges.select("src", "dst", "kind"), nodes, "src", rows), nodes, "dst", rows)
    ids = apart(nodes.select("id"))
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")


def caller_edges(edges: DataFrame) -> DataFrame:
    """TRV-08: the kinds that count for entries."""
    return edges.filter(F.col("kind").isin(*S.CALLER_KINDS))


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")


def hops_from(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """TRV-04: root, node and hop of what each root reaches, the root itself left out.

    seeds: root and node, all at hop 0. Each root's seeds are visited from the start, so none is in
    the result.
    """
    step = edges.select("src", "dst").filter("src != dst").distinct()
    return _hops(step if max_hops == 1 else cut(step), seeds, max_hops)


def _hops(step: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """hops_from() over distinct src and dst without self-loops."""
    found, rows = counted(seeds.select("root", "node", F.lit(0).alias("hop")).distinct(), "seeds")
    frontier, hop, total = side(found, rows), 0, rows
    while max_hops is None or hop < max_hops:
        hop += 1
        new = step.join(frontier.select("root", F.col("node").alias("src")), "src").select("root", F.col("dst").alias("node")).distinct()
        seen = found.select("root", "node")
        new = new.join(apart(seen) if total > LARGE else seen, ["root", "node"], "left_anti").withColumn("hop", F.lit(hop))
        new, rows = counted(new, "hop")
        if not rows:
            break
        found, frontier, total = found.unionByName(new), side(new, rows), total + rows
    return found.filter("hop > 0")


def _bounded(edges: DataFrame, hops: int) -> DataFrame:
    """Pairs (id, other) up to so many steps along the edges, ends apart."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).filter("id != other").distinct()
    reach, tip = step, step
    for _ in range(hops - 1):
        tip = tip.join(step.select(F.col("id").alias("other"), F.col("other").alias("further")), "other").select("id", F.col("further").alias("other")).filter("id != other").distinct()
        reach = reach.unionByName(tip)
    return reach.distinct()


def blast_radius(nodes: DataFrame, edges: DataFrame, hops: int | float = S.DEFAULT_HOPS) -> DataFrame:
    """TRV-05, SET-01: id and other, for every node: what a forward or a backward walk of so many hops
    reaches, not itself. A number of hops that is no positive integer reaches nothing."""
    if hops != int(hops) or hops < 1:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).limit(0)
    good = cut(valid_edges(nodes, edges).filter("src != dst").select("src", "dst", F.lit("").alias("kind")).distinct())
    return _bounded(good, int(hops)).unionByName(_bounded(flipped(good), int(hops))).distinct()


def blast_counts(nodes: DataFrame, edges: DataFrame, hops: int | float = S.DEFAULT_HOPS) -> DataFrame:
    """TRV-06: id and blast_radius for every node, 0 for those apart."""
    if hops != int(hops) or hops < 1:
        return nodes.select("id").distinct().withColumn("blast_radius", F.lit(0).cast("long"))
    return neighbourhood.counts(nodes, edges, int(hops)).withColumnRenamed("n", "blast_radius")


def expansion(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """TRV-07: id and hop, the nearer of both directions, from a set of seed ids; unknown seeds and all seeds left out."""
    step = cut(valid_edges(nodes, edges).filter("src != dst").select("src", "dst").distinct())
    back = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    known = cut(seeds.select("id").distinct().join(nodes.select("id").distinct(), "id", "left_semi").select(F.lit("").alias("root"), F.col("id").alias("node")))
    both = _hops(step, known).unionByName(_hops(back, known))
    return both.groupBy(F.col("node").alias("id")).agg(F.min("hop").alias("hop"))


def resolve(nodes: DataFrame, query: str) -> DataFrame:
    """TRV-01: the nodes of the best tier that matches: id, then name, then part of a name, all without case.

    Each row has tier and matches (how many); equal ids but for case give the lowest id. The caller
    reads the state: no row, one, or several.
    """
    q = F.lit(query.strip().lower())
    tier = F.when(F.lower("id") == q, 1).when(F.lower("name") == q, 2).when(F.contains(F.lower("name"), q), 3)
    told = nodes.withColumn("tier", tier)
    # one row: the best tier, how many nodes it has, and the lowest of equal ids
    counts = [F.count_if(F.col("tier") == k).alias(f"n{k}") for k in (1, 2, 3)]
    found = told.agg(F.min("tier").alias("best"), F.min(F.when(F.col("tier") == 1, F.col("id"))).alias("low"), *counts).first()
    hits = told.filter(F.col("tier") == F.lit(found["best"]))
    if found["best"] == 1:
        return hits.filter(F.col("id") == F.lit(found["low"])).withColumn("matches", F.lit(1).cast("long"))
    return hits.withColumn("matches", F.lit(found[f"n{found['best']}"] if found["best"] else 0).cast("long"))


def call_tree(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """TRV-02: id, parent, depth and pos (place in the queue) of a breadth-first walk over CALLS from each start id.

    start: id; its rows are roots of walks of their own. Column root names the walk. A node's parent
    is the first in the queue to reach it; children of one parent queue up by id.
    """
    # ends are looked up for what a level finds, not for all edges
    calls = cut(edges.filter("kind = 'CALLS' AND src != dst").select(F.col("src").alias("parent"), F.col("dst").alias("child")))
    level, rows = counted(start.select(F.col("id").alias("root"), "id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pos")).distinct(), "start")
    seen, depth, total = level, 0, rows
    level = _known(level, rows, nodes)
    while True:
        depth += 1
        base = seen.groupBy("root").agg(F.count(F.lit(1)).alias("base"))
        tip = side(level.select("root", F.col("id").alias("parent"), "pos"), rows)
        new = calls.join(tip, "parent").groupBy("root", F.col("child").alias("id")).agg(F.min(F.struct("pos", "parent")).alias("via"))
        been = seen.select("root", "id")
        new, rows = counted(new.join(apart(been) if total > LARGE else been, ["root", "id"], "left_anti"), "level")
        if not rows:
            return seen
        new = _known(new, rows, nodes).join(base, "root")
        place = F.row_number().over(Window.partitionBy("root").orderBy("via.pos", "id"))
        level, rows = counted(new.select("root", "id", F.col("via.parent").alias("parent"), F.lit(depth).alias("depth"), (F.col("base") + place - 1).alias("pos")), "level")
        if not rows:
            return seen
        seen, total = seen.unionByName(level), total + rows


def _known(found: DataFrame, rows: int, nodes: DataFrame) -> DataFrame:
    """The rows of found, so many, whose id is a node's. Nodes stay where they are if rows are few."""
    ids = nodes.select("id")
    if rows <= LARGE:
        ids = ids.join(F.broadcast(found.select("id").distinct()), "id", "left_semi")
    return found.join(ids, "id", "left_semi")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TRV-09: nodes that nothing but themselves calls or uses."""
    # a node that is called is known: only callers are looked up
    by = caller_edges(edges).filter("src != dst").join(apart(nodes.select(F.col("id").alias("src"))), "src", "left_semi")
    return nodes.join(apart(by.select(F.col("dst").alias("id")).distinct()), "id", "left_anti")


def reach(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """TRV-10, TRV-14: root and node of everything each start id reaches over calls and uses, itself left out."""
    good = valid_edges(nodes, caller_edges(edges))
    return hops_from(good, starts.select(F.col("id").alias("root"), F.col("id").alias("node"))).select("root", "node")


def callees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """TRV-15: id and other, each once."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).join(ids, "id", "left_semi").distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """JOIN-24, TRV-16: id, other, and whether other is a caller or a callee; each once, never itself. rows: see with_end()."""
    e = valid_edges(nodes, edges, rows).filter("src != dst").select("src", "dst").distinct()
    return e.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("callee").alias("side")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("caller").alias("side")))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """TRV-17: CALLS between the given ids, no self-loops, each once."""
    a, b = ids.select(F.col("id").alias("src")).distinct(), ids.select(F.col("id").alias("dst")).distinct()
    return edges.filter("kind = 'CALLS' AND src != dst").join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst").distinct()
