"""Walks read their edges once, and large tables are dealt so that a task's share doesn't grow with them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewright.operators import condense, neighbourhood, review, traverse
from tracewright.plans import graph_view

NAMES = [f"n{i}" for i in range(9)]


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame([(x, x) for x in NAMES], "id string, name string")


def told(spark, rows):
    """Edges, and how many of them were read so far."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame(rows, "src string, dst string, kind string")
    return edges.withColumn("src", F.udf(look, "string").asNondeterministic()("src")), seen


CHAIN = [(a, b, "CALLS") for a, b in zip(NAMES, NAMES[1:], strict=False)]


def test_expansion_reads_edges_once(spark, nodes):
    edges, seen = told(spark, [*CHAIN, ("n3", "x", "CALLS"), ("x", "n4", "CALLS")])
    got = traverse.expansion(nodes, edges, spark.createDataFrame([("n2",), ("y",)], "id string"))
    assert {tuple(r) for r in got.collect()} == {("n0", 2), ("n1", 1), *[(f"n{i}", i - 2) for i in range(3, 9)]}
    assert seen.value == len(CHAIN) + 2


def test_call_tree_reads_edges_once(spark, nodes):
    edges, seen = told(spark, [*CHAIN, *CHAIN, ("n0", "n2", "CALLS"), ("n0", "x", "CALLS"), ("x", "n8", "CALLS"), ("n1", "n5", "USAGE")])
    tree = traverse.call_tree(nodes, edges, spark.createDataFrame([("n0",), ("x",)], "id string"))
    rows = {(r["root"], r["id"]): (r["parent"], r["depth"], r["pos"]) for r in tree.collect()}
    want = {("n0", "n0"): (None, 0, 0), ("n0", "n1"): ("n0", 1, 1), ("n0", "n2"): ("n0", 1, 2), ("x", "x"): (None, 0, 0)}
    want |= {("n0", f"n{i}"): (f"n{i - 1}", i - 1, i) for i in range(3, 9)}
    assert rows == want
    assert seen.value == 2 * len(CHAIN) + 4


@pytest.mark.parametrize("back", [[], [("n4", "n2", "CALLS")]])
def test_upper_bounds_read_edges_once(spark, nodes, back):
    edges, seen = told(spark, CHAIN + back)
    got = dict(map(tuple, condense.reach_upper_bounds(nodes, edges).collect()))
    assert got == {f"n{i}": 8 - (2 if back and 2 <= i <= 4 else i) for i in range(9)}
    assert seen.value == len(CHAIN) + len(back)


def test_pairs_are_told_apart_once(spark, nodes):
    got = neighbourhood.counts(nodes, spark.createDataFrame(CHAIN, "src string, dst string, kind string"), 2)
    # one to tell pairs apart, one to count them
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
    assert dict(map(tuple, got.collect())) == {"n0": 2, "n1": 3, **{f"n{i}": 4 for i in range(2, 7)}, "n7": 3, "n8": 2}


def test_roots_look_up_callers_alone(spark, nodes):
    edges = spark.createDataFrame([("n0", "n1", "CALLS"), ("x", "n2", "CALLS"), ("n3", "n3", "CALLS"), ("n0", "y", "USAGE")], "src string, dst string, kind string")
    got = traverse.roots(nodes, edges)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
    assert {r["id"] for r in got.collect()} == set(NAMES) - {"n1"}


def test_sales_are_dealt_by_their_number(spark, monkeypatch):
    rows = [(o, p, f) for o in range(40) for p in range(5) for f in "ANR"[: 1 + (o + p) % 3]] + [(99, 1, None), (99, 2, "X"), (99, 2, "R")]
    items = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string")
    monkeypatch.setattr(graph_view, "ITEMS", 100)
    got = graph_view._sales(items)
    assert got.rdd.getNumPartitions() == 1 + len(rows) // 100
    assert dict(((r[0], r[1]), r[2]) for r in got.collect()) == {**{(o, p): "USAGE" if (o + p) % 3 == 2 else "CALLS" for o in range(40) for p in range(5)}, (99, 1): "CALLS", (99, 2): "CALLS"}


def test_cluster_edges_are_dealt_once_for_each_end(spark):
    edges = spark.createDataFrame([("a", "x", "CALLS", 1), ("a", "x", "CALLS", 1), ("b", "x", "USAGE", 2), ("x", "y", "CALLS", 3), ("a", "b", "CALLS", 4), ("y", "z", "CALLS", 5), ("x", "gone", "CALLS", 6), ("y", "b", "CALLS", 7)], "src string, dst string, kind string, ord long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = review.cluster_edges(edges, ids("x", "x", "b", "gone"), spark.createDataFrame([("a", "A"), ("b", "A"), ("z", None)], "id string, cluster string"), ids("x", "y", "a", "z"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 6
    assert {tuple(r) for r in got.collect()} == {("A", "x", 2, 2), ("x", "y", 1, 1), ("y", "A", 1, 1)}
