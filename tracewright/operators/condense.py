"""Condensation of a directed graph into strongly connected components, and bounds of reach: TRV-11.

All of it goes in rounds of joins and grouped sums. Nodes that lie on no cycle fall off first, a layer
from either end a round; what is left is split by colours: each node takes the largest id that
reaches it, and those of a colour that reach its first node are a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import LARGE, apart, counted, side
from .traverse import cut


def _trimmed(edges: DataFrame, now: int | None = None) -> DataFrame:
    """Edges less those of nodes that nothing leads to, or that lead nowhere, until none is left to take. now: their number, if they are written."""
    if now is None:
        edges, now = counted(edges, "edges")
    n = None
    while now not in (0, n):
        edges = apart(edges) if now > LARGE else edges
        entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        after = edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi")
        n = now
        edges, now = counted(after, "edges")
    return apart(edges) if now > LARGE else edges


def _coloured(edges: DataFrame) -> DataFrame:
    """node and colour: the largest id that reaches the node, itself included."""
    colours = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
    while True:
        came = edges.join(colours.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("came"))
        after = cut(colours.join(came, "node", "left").select("node", F.greatest("colour", "came").alias("colour"), (F.col("came") > F.col("colour")).alias("moved")))
        colours = after.select("node", "colour")
        if after.filter("moved").isEmpty():
            return colours


def _cyclic(edges: DataFrame, n: int | None = None) -> DataFrame | None:
    """node and colour (one node of its component) of the nodes that lie on a cycle; None without any. n: see _trimmed."""
    rest = _trimmed(edges, n)
    found = None
    while not rest.isEmpty():
        colours = _coloured(rest)
        own = colours.withColumnRenamed("node", "src").withColumnRenamed("colour", "c")
        inner = cut(rest.join(own, "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("c")), ["dst", "c"]).select("src", "dst", "c"))
        group = tip = cut(colours.filter("node = colour"))
        while not tip.isEmpty():
            back = inner.join(tip.select(F.col("node").alias("dst"), F.col("colour").alias("c")), ["dst", "c"]).select(F.col("src").alias("node"), F.col("c").alias("colour")).distinct()
            tip = cut(back.join(group, ["node", "colour"], "left_anti"))
            group = group.unionByName(tip)
        group = cut(group)
        found = group if found is None else found.unionByName(group)
        done = group.select("node")
        rest = _trimmed(rest.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return found


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (one of its ids) of each node: those that reach each other share one."""
    return _named(nodes, _cyclic(edges.select("src", "dst").filter("src != dst").distinct()))


def _named(nodes: DataFrame, found: DataFrame | None) -> DataFrame:
    ids = nodes.select("id").distinct()
    if found is None:
        return ids.withColumn("component", F.col("id"))
    return ids.join(found.select(F.col("node").alias("id"), F.col("colour").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def reach_upper_bounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TRV-11: id and bound, never less than the number of other nodes that a node reaches.

    A component's bound is its size and the bounds of the components that it leads to, at most the
    number of nodes; a node's is its component's less itself. Exact on a tree. A round for each
    layer of the condensation. Ends of edges must be nodes.
    """
    edges, n = counted(edges.select("src", "dst").filter("src != dst").distinct(), "edges")
    edges = apart(edges) if n > LARGE else edges
    cyclic = _cyclic(edges, n)
    of, whole = counted(_named(nodes, cyclic), "components")
    of = apart(of) if whole > LARGE else of
    steps = edges.select(F.col("src").alias("c"), F.col("dst").alias("to"))
    if cyclic is not None:
        # a node on no cycle is its own component, so only those on one are looked up
        name = lambda c: cyclic.select(F.col("node").alias(c), F.col("colour").alias("c" + c))
        ends = edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left").select(F.coalesce("csrc", "src").alias("c"), F.coalesce("cdst", "dst").alias("to"))
        steps = cut(ends.filter("c != to").distinct())
    # of each component: its bound so far, and how many of its successors are still open
    left = steps.groupBy("c").agg(F.count(F.lit(1)).alias("left"))
    sizes = of.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("bound"))
    state = cut(sizes.join(left, "c", "left").select("c", "bound", F.coalesce("left", F.lit(0).cast("long")).alias("left")))
    known = None
    while True:
        ready, n = counted(state.filter("left = 0").select("c", F.least("bound", F.lit(whole)).alias("bound")), "ready")
        if not n:
            break
        known = ready if known is None else known.unionByName(ready)
        came = steps.join(side(ready.select(F.col("c").alias("to"), F.col("bound").alias("more")), n), "to").groupBy("c").agg(F.sum("more").alias("more"), F.count(F.lit(1)).alias("n"))
        rest = state.filter("left > 0").join(came, "c", "left")
        state = cut(rest.select("c", (F.col("bound") + F.coalesce("more", F.lit(0))).alias("bound"), (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")))
    if known is None:
        return of.select("id", F.lit(0).cast("long").alias("bound"))
    return of.join(known.withColumnRenamed("c", "component"), "component").select("id", (F.col("bound") - 1).alias("bound"))
