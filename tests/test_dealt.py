"""Tasks of joins and groupings have so many rows at most, however few partitions the session has."""

import pytest
from conftest import rows

import __spark_entry__ as entry
from tracewright import storage
from tracewright.operators import community, diff, fold, scope, traverse
from tracewright.sources import lcov

EDGES = [("a", "b", "CALLS", 3), ("b", "a", "USAGE", 1), ("a", "t", "USAGE", 4), ("m", "a", "CALLS", 5), ("m", "i", "USAGE", 6), ("b", "i", "USAGE", 7), ("a", "gone", "CALLS", 8), ("b", "b", "CALLS", 9), ("a", None, "CALLS", 10)]
NODES = [("a", "f.ts", 1, 9, "Function", 1), ("b", "f.ts", 1, 9, "Function", 0), ("t", "f.test.ts", 1, 9, "Function", 2), ("m", "f.ts", 1, 99, "Module", 3), ("i", "f.ts", 2, 5, "Type", 4), ("a", "f.ts", 1, 9, "Function", 1)]


@pytest.fixture
def graph(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK", 10)
    n = spark.createDataFrame([(i, i, *rest[:4], False, None, None, rest[4]) for i, *rest in NODES], "id string, name string, file string, start_line int, end_line int, kind string, is_test boolean, complexity double, cognitive double, ord long")
    return n, spark.createDataFrame(EDGES, "src string, dst string, kind string, ord long")


def dealt(df, least=101):
    assert df.rdd.getNumPartitions() >= least
    return rows(df)


def test_neighbours_are_dealt_by_their_number(graph):
    assert dealt(traverse.neighbours(*graph, 1000)) == rows(traverse.neighbours(*graph)) != []


def test_edges_without_tests_are_dealt_by_their_number(graph):
    got = dealt(scope.exclude_tests(*graph, 1000)[1])
    assert got == rows(scope.exclude_tests(*graph)[1]) == sorted((e for e in EDGES if e[1] != "t"), key=repr)


def test_pairs_are_hashed_and_dealt_by_their_number(graph):
    got = community.directed_pairs(*graph, 1000)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert dealt(got) == [("a", "t"), ("b", "a"), ("b", "i"), ("m", "a"), ("m", "i")]


def test_folds_are_dealt_by_their_number(spark, graph):
    m = fold.modules(*graph, 1000)
    assert rows(m["uses"], "file", "id") == [("f.ts", "a"), ("f.ts", "i")]
    assert dealt(m["edges"]) == sorted((e for e in EDGES if e[0] != "m"), key=repr)
    t = fold.types(m["nodes"], m["edges"], spark.createDataFrame([], "source string, target string"), 1000)
    assert dealt(t["used_by"]) == [("i", "b", "Function")]


def test_nodes_of_one_range_meet_lines_not_points(spark, graph):
    n, points = graph[0], spark.createDataFrame([("f.ts", 1 + i % 3, i, f"p{i}", "info") for i in range(60)] + [("f.ts", 100, 60, "out", "info")], "file string, line int, point long, message string, severity string")
    got = diff.findings_of_nodes(n, points, "pr-bot", "major", 1000)
    # the smallest around a line; of equals the first by ord, with its own range
    want = sorted([("i", "pr-bot", "major", f"p{i}", "f.ts", 2, 5, i) if i % 3 else ("b", "pr-bot", "major", f"p{i}", "f.ts", 1, 9, i) for i in range(60)], key=repr)
    assert dealt(got) == want == rows(diff.findings_of_nodes(n, points, "pr-bot", "major"))
    plan = diff.enclosing(n, points)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("Aggregate [") == 3


def test_listings_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK", 100)
    dealt(entry.queries()["changed_names"](spark, "/root/testdata/sf0.001"), 61)


def test_lines_of_reports_meet_no_join(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK", 10)
    text = "DA:1,9|SF:./a.ts|DA:1,2|FN:3,f|TN:x|FNDA:4,f|DA:1,2|DA:x,1|end_of_record|DA:2,9|SF:b.ts| DA:1,1|SF:./a.ts|DA:1,3|FNDA:4,f|end_of_record"
    lines = spark.createDataFrame([(r, i, x) for r in ("r", "s", None) for i, x in enumerate(text.split("|"))], "report string, n long, line string")
    got = lcov.parse(lines, rows=1000)
    assert "Join " not in got["lines"]._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got["lines"]) == [("a.ts", 1, 14), ("b.ts", 1, 2)]
    assert rows(got["hits"]) == [("a.ts", "f", 16)] and rows(got["functions"]) == [("a.ts", "f", 3)] and rows(got["files"]) == [("a.ts",), ("b.ts",)]
