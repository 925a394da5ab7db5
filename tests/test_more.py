import os
import random
import sys

from conftest import rows

from tracewright.functions import text
from tracewright.operators import canvas, condense, generate
from tracewright.plans import queries as Q
from pyspark.sql import functions as F

TESTDATA = "/root/testdata/sf0.001"


def test_canvas(spark):
    n = spark.createDataFrame([("f",), ("g",), ("alone",), ("f",)], "id string")
    t = spark.createDataFrame([("T", "Type")], "id string, kind string")
    used = spark.createDataFrame([("T", "f"), ("T", "gone")], "type string, id string")
    m = spark.createDataFrame([("m.ts",)], "file string")
    uses = spark.createDataFrame([("m.ts", "g"), ("m.ts", "g"), ("m.ts", "x")], "file string, id string")
    cards, links = canvas.folded_elements(n, t, used, m, uses)
    assert rows(cards) == [("T", "Type"), ("m.ts", "Module")] and rows(links) == [("f", "T"), ("m.ts", "g")]
    assert rows(canvas.unique_ids(n)) == [("f", 2)]
    words = spark.createDataFrame([("\U0001f600",), ("ﬀ",)], "w string")
    assert [r.w for r in words.orderBy(canvas.utf16_order("w")).collect()] == ["\U0001f600", "ﬀ"]
    good, dropped = canvas.parsed(n, lambda d: d.filter("id != 'alone'"))
    assert good.count() == 3 and rows(dropped) == [(1,)]
    c = spark.createDataFrame([("a", "a", "f", 3, False), ("b", None, "f", 3, False), ("p", None, None, None, True)], "id string, name string, file string, reach int, pinned boolean")
    ok, hidden = canvas.valid_candidates(c)
    assert rows(ok, "id") == [("a",)] and rows(hidden) == [("p",)]


def plain_bounds(ids, pairs):
    """Bounds by the definition, over components found from mutual reach."""
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in pairs:
            reach[a] |= reach[b]
    comp = {i: min(j for j in ids if i in reach[j] and j in reach[i]) for i in ids}

    def bound(c):
        members = [i for i in ids if comp[i] == c]
        after = {comp[b] for a, b in pairs if comp[a] == c} - {c}
        return min(len(ids), len(members) + sum(bound(x) for x in after))

    return comp, {i: bound(comp[i]) - 1 for i in ids}, {i: len(reach[i]) - 1 for i in ids}


def test_reach_bounds(spark):
    chain = [("a", "b"), ("b", "c")]
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    edges = lambda pairs: spark.createDataFrame(pairs, "src string, dst string")
    assert rows(condense.reach_upper_bounds(frame("abcd"), edges(chain))) == [("a", 2), ("b", 1), ("c", 0), ("d", 0)]
    assert rows(condense.reach_upper_bounds(frame("ab"), edges([]))) == [("a", 0), ("b", 0)]
    r = random.Random(3)
    ids = [f"n{i:02}" for i in range(20)]
    pairs = sorted({(r.choice(ids), r.choice(ids)) for _ in range(26)})
    pairs = [(a, b) for a, b in pairs if a != b]
    comp, bounds, reach = plain_bounds(ids, pairs)
    got = dict(rows(condense.components(frame(ids), edges(pairs))))
    assert all((comp[a] == comp[b]) == (got[a] == got[b]) for a in ids for b in ids) and len(set(comp.values())) < 20
    got = dict(rows(condense.reach_upper_bounds(frame(ids), edges(pairs))))
    assert got == bounds and all(got[i] >= reach[i] for i in ids)


def test_generated(spark):
    def make():
        def answer(prompt):
            if prompt == "deny":
                raise generate.AuthFailure
            if prompt == "break":
                raise RuntimeError
            return f" {prompt}\u00a0 \n" if prompt != "blank" else " \n"

        return answer

    p = spark.createDataFrame([(1, "say"), (2, None), (3, "blank"), (4, "break"), (5, "again"), (6, "deny"), (7, "late"), (8, None)], "id int, prompt string").coalesce(1)
    assert rows(generate.generated(p, "stub", make)) == [(1, "success", "say"), (2, "unreadable", None), (3, "degenerate", None), (4, "failed", None), (5, "success", "again"), (6, "failed", None), (7, "skipped", None), (8, "unreadable", None)]


def test_small_expressions(spark):
    one = spark.range(1)
    assert one.select(text.positive_integer(F.lit(2.0)), text.positive_integer(F.lit(1.5)), text.positive_integer(F.lit(None).cast("double"))).first()[:] == (True, False, False)
    assert "Function f in a.ts" in one.select(text.prompt(F.lit("f"), F.lit("Function"), F.lit("a.ts"), F.lit("body"))).first()[0]


def test_every_query_names_its_operators():
    assert all(f.__doc__ for f in Q.QUERIES.values()) and set(Q.ORACLES) <= set(Q.QUERIES)


def test_entry_without_llm(tmp_path):
    """The registry works where the training-data operators are gone."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = tmp_path / "repo"
    shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and not [x for x in q if x.startswith('op') or x == 'pipeline']"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=to, env=env, capture_output=True, text=True).stderr == ""


def test_louvain_takes_every_node(spark, monkeypatch):
    seen = []

    def partition(n, e):
        seen.append((n.count(), e.count()))
        return n.select("id", F.lit("0").alias("group"))

    monkeypatch.setattr(Q.community, "partition", partition)
    Q.QUERIES["louvain_partition"](spark, TESTDATA)
    assert seen == [(Q.g.nodes(spark, TESTDATA).count(), Q.g.edges(spark, TESTDATA).count())]


def test_queries_without_id_subsets(spark):
    n = Q.g.nodes(spark, TESTDATA)
    got = Q.QUERIES["review_sort_nulls_last"](spark, TESTDATA).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, n.count() + 1)) and {r.id[0] for r in got} == set("PSCONR")
    assert got[-1].complexity is None and sum(r.complexity is not None for r in got) == n.filter("complexity IS NOT NULL").count()
    links = Q.QUERIES["test_file_links"](spark, TESTDATA)
    assert links.filter("file LIKE 'suppliers/%' AND test_file LIKE 'Brand%'").count() > 0
