"""Exact reach against a plain walk, on graphs with and without cycles, with places and with bitmaps."""

import random

import pytest
from conftest import rows

from tracewright.operators import reach


def plain(ids, pairs):
    out = {}
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in after.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = seen - {i}
    return out


def graph(spark, ids, pairs):
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize("kind, most", [("dag", 1024), ("dag", 3), ("cycles", 1024), ("cycles", 2)])
def test_reach_equals_walks(spark, kind, most):
    r = random.Random(kind)
    ids = [f"n{i:02}" for i in range(40)]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(55)]
    if kind == "dag":
        pairs = [(min(p), max(p)) for p in pairs]
    n, e = graph(spark, ids, [*pairs, *pairs[:3], (ids[0], ids[0])])
    found, want = reach.reach(n, e, most), plain(ids, pairs)
    assert dict(rows(found.counts())) == {i: len(w) for i, w in want.items()}
    some = ids[:7]
    assert rows(found.of(spark.createDataFrame([(i,) for i in [*some, some[0], "gone"]], "id string"))) == sorted(((i, j) for i in some for j in want[i]), key=repr)


def test_reach_of_diamonds_and_of_nothing(spark):
    """A stack of diamonds, where sums of bounds would double with each."""
    pairs = [p for k in range(6) for p in ((f"t{k}", f"l{k}"), (f"t{k}", f"r{k}"), (f"l{k}", f"t{k + 1}"), (f"r{k}", f"t{k + 1}"))]
    ids = sorted({i for p in pairs for i in p})
    assert dict(rows(reach.reach(*graph(spark, ids, pairs)).counts()))["t0"] == 18
    assert rows(reach.reach(*graph(spark, ["a"], [])).counts()) == [("a", 0)]
    assert rows(reach.reach(*graph(spark, [], [])).counts()) == []


def test_large_tables_are_never_sent_whole(spark, tmp_path, monkeypatch):
    """Their files may be small, a hash table of them isn't."""
    from tracewright import storage
    from tracewright.operators import traverse

    monkeypatch.setattr(storage, "LARGE", 10, raising=False)
    ids = [f"n{i}" for i in range(20)]
    n, e = graph(spark, ids, list(zip(ids, ids[1:], strict=False)))
    found = reach.reach(n, e).counts()
    assert dict(rows(found)) == {i: 19 - k for k, i in enumerate(ids)}
    n.write.parquet(str(tmp_path / "ids"))
    valid = traverse.valid_edges(spark.read.parquet(str(tmp_path / "ids")), e.selectExpr("*", "'CALLS' AS kind"))
    for df in (found, valid):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_closures_above_which_nothing_is_are_counted_not_kept(spark, monkeypatch):
    """One row for each component that another needs, whatever its numbers' buckets; the roots' layer has counts alone."""
    kept = {}
    there = reach.written
    monkeypatch.setattr(reach, "written", lambda df, label: kept.setdefault(label, there(df, label)))
    ids = [f"n{i:02}" for i in range(24)]
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :: 5] if i % 3]
    assert dict(rows(reach.reach(*graph(spark, ids, pairs)).counts())) == {i: len(w) for i, w in plain(ids, pairs).items()}
    closures = {k: v for k, v in kept.items() if k.startswith("closures")}
    assert closures and all(v.count() == v.select("c").distinct().count() and v.columns == ["c", "nums"] for v in closures.values())
    assert f"closures-{len(closures)}" not in kept and f"sizes-{len(closures)}" in kept


@pytest.mark.parametrize("walks", [True, False])
def test_roots_are_counted_only_where_bounds_leave_them_open(spark, monkeypatch, walks):
    """The widest few as from plain walks, whose closures aren't formed; all closures only where walks would find more than those."""
    from tracewright.operators import entry

    r = random.Random(7)
    roots, inner = [f"r{i:02}" for i in range(30)], [f"n{i:02}" for i in range(12)]
    pairs = [(a, b) for a in roots for b in r.sample(inner, r.randrange(5))] + [(a, b) for i, a in enumerate(inner) for b in inner[i + 1 :] if r.random() < 0.2]
    n, e = graph(spark, [*roots, *inner], pairs)
    want = plain([*roots, *inner], pairs)
    called = {b for _, b in pairs}
    wide = {i: len(w) for i, w in want.items() if i not in called and len(w) >= 3}
    g = reach.layered(n, e)
    if walks:
        monkeypatch.setattr(entry, "sizes_of", lambda *_: pytest.fail("all closures"))
    else:
        monkeypatch.setattr(entry, "LARGE", 0)
        g.rows = 0
    assert entry._widest(g, g.roots(), 4, 3, 5) == (sorted(wide, key=lambda i: (-wide[i], i))[:4], len(wide))
