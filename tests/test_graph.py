import itertools
import math
import random

from conftest import rows

from tracewright import schema as S
from tracewright.engine import Engine, Inputs
from tracewright.operators import community, coverage, diff, entry, fold, layout, links, review, risk, scope, traverse
from tracewright.operators.reveal import History, Tree, toggle_pin

CALLS = [("entry", "a"), ("entry", "b"), ("a", "repo"), ("b", "repo"), ("repo", "cache"), ("cache", "repo")]


def nodes_of(spark, ids, **more):
    rows_ = [(i, more.get("names", {}).get(i, i), more.get("files", {}).get(i, f"src/{i}.ts"), 1, 9, more.get("kinds", {}).get(i, "Function"), False, None, None, k) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows_, S.NODES + ", ord long")


def edges_of(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(a, b, k[0] if k else kind, i) for i, (a, b, *k) in enumerate(pairs)], S.EDGES + ", ord long")


def test_call_tree_order_parents_depths(spark):
    ids = ["entry", "a", "b", "repo", "cache", "helper1", "helper2"]
    n, e = nodes_of(spark, ids, names={"helper1": "helper", "helper2": "helper"}), edges_of(spark, CALLS)
    tree = traverse.call_tree(n, e, traverse.resolve(n, "ENTRY ").select("id")).orderBy("pos").collect()
    assert [(r.id, r.parent, r.depth) for r in tree] == [("entry", None, 0), ("a", "entry", 1), ("b", "entry", 1), ("repo", "a", 2), ("cache", "repo", 3)]
    assert [r.id for r in traverse.preorder(traverse.call_tree(n, e, n.filter("id = 'entry'").select("id"))).orderBy("ord").collect()] == ["entry", "a", "repo", "cache", "b"]
    eng = Engine(Inputs(n, e))
    assert eng.trace_path("helper").status == "ambiguous"
    assert eng.trace_path("nothing").status == "no-path-found"
    assert eng.trace_path("cache").facts["start"] == "cache"
    assert eng.lookup_node("a").status == "found" and eng.lookup_node("zz").status == "not-found"


def test_blast_radius_shapes(spark):
    def counts(pairs, ids, hops=2):
        return dict(rows(traverse.blast_counts(nodes_of(spark, ids), edges_of(spark, pairs), hops)))

    assert counts([("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")], "ABCDE") == {"A": 2, "B": 3, "C": 4, "D": 3, "E": 2}
    hub = [("H", f"S{i}", k) for i, k in enumerate(["CALLS", "CALLS", "IMPORTS", "USAGE", "CALLS"])]
    assert counts(hub, ["H", *[f"S{i}" for i in range(5)]]) == {"H": 5} | {f"S{i}": 1 for i in range(5)}
    assert counts([("A", "B"), ("B", "C"), ("C", "A")], "ABC") == {"A": 2, "B": 2, "C": 2}
    assert counts([("A", "A"), ("A", "ghost")], "AB") == {"A": 0, "B": 0}
    assert counts([("A", "B")], "AB", 1.5) == {"A": 0, "B": 0}


def walk(adj, seeds, most=None):
    seen, level, out, hop = set(seeds), set(seeds), {}, 0
    while level and (most is None or hop < most):
        hop += 1
        level = {b for a in level for b in adj.get(a, ()) if b not in seen}
        seen |= level
        out |= dict.fromkeys(level, hop)
    return out


def test_random_graphs_against_plain_walks(spark):
    for seed in range(3):
        r = random.Random(seed)
        ids = [f"n{i}" for i in range(14)]
        pairs = [(r.choice(ids), r.choice([*ids, "ghost"]), r.choice(["CALLS", "USAGE", "IMPORTS"])) for _ in range(26)]
        n, e = nodes_of(spark, ids), edges_of(spark, pairs)
        fwd, back, use = {}, {}, {}
        for a, b, k in pairs:
            if b != "ghost" and a != b:
                fwd.setdefault(a, set()).add(b)
                back.setdefault(b, set()).add(a)
                if k != "IMPORTS":
                    use.setdefault(a, set()).add(b)
        want = {i: len(set(walk(fwd, [i], 2)) | set(walk(back, [i], 2))) for i in ids}
        assert dict(rows(traverse.blast_counts(n, e))) == want
        seeds = spark.createDataFrame([("n1",), ("n2",), ("ghost",)], "id string")
        f, b = walk(fwd, ["n1", "n2"]), walk(back, ["n1", "n2"])
        assert dict(rows(traverse.expansion(n, e, seeds))) == {k: min(f.get(k, 99), b.get(k, 99)) for k in f.keys() | b.keys()}
        assert dict(rows(traverse.expansion(n.repartition(5), e.orderBy("dst"), seeds))) == {k: min(f.get(k, 99), b.get(k, 99)) for k in f.keys() | b.keys()}
        called = {b for bs in use.values() for b in bs}
        reach = {i: len(walk(use, [i])) for i in ids if i not in called}
        got = entry.candidates(n, e, ["n5", "n5", "gone"])[0].orderBy("pos").collect()
        best = sorted((i for i in reach if reach[i] >= 3 and i != "n5"), key=lambda i: (-reach[i], i))
        assert [x.id for x in got] == ["n5", *best[:12]] and got[0].total_qualifying == len(best) + 1


def test_sections_and_scope(spark):
    ids = ["handler", "validate", "render", "layout", "app"]
    files = {"handler": "api/h.ts", "validate": "api/v.ts", "render": "web/r.ts", "layout": "web/l.ts", "app": "webapp/x.ts"}
    n, e = nodes_of(spark, ids, files=files), edges_of(spark, [("handler", "render"), ("handler", "render"), ("render", "layout"), ("handler", "ghost")])
    assert rows(scope.section_counts(n, ["api", "web", "api", "none"])) == [(0, "api", 2), (1, "web", 2), (2, "none", 0)]
    assert rows(scope.with_section(n, ["web", "api"]), "id", "section")[0] == ("app", None)
    assert rows(scope.cross_section_edges(n, e, ["api", "web"])) == [("api", "web", 2, 0), ("web", "api", 0, 2)]
    assert [r.callee for r in scope.cross_section_calls(n, e, ["api", "web"]).collect()] == ["render"]
    assert scope.filter_to_scope(n, e, [])[1].count() == 4 and scope.filter_to_scope(n, e, ["api", "web"])[1].count() == 3
    eng = Engine(Inputs(n, e), ["api", "web"])
    assert eng.code_map("nope").status == "unknown-section"
    assert eng.lookup_node("render", "api").facts == {"section": "web"}
    m = eng.code_map("api")
    assert m.frames["cross_edges"].count() == 1 and m.frames["nodes"].count() == 2


def test_links(spark):
    pairs = spark.createDataFrame([("M", "C", 32, 0.89, 0), ("P", "C", 27, 1.0, 1), ("C", "S", 34, 0.74, 2), ("C", "M", 20, 0.99, 3), ("M", "P", 4, 1.0, 4), ("S", "P", 9, None, 5)], S.CO_CHANGES)
    got = links.co_changes(pairs)
    assert [(r.partner, r.co_changes, r.total) for r in got.filter("file = 'C'").orderBy("rank").collect()] == [("S", 34, 3), ("M", 32, 3), ("P", 27, 3)]
    assert [r.partner for r in got.filter("file = 'M'").collect()] == ["C"]
    n = nodes_of(spark, ["f", "g", "h", "t1", "dup", "dup"], files={"t1": "src/a.test.ts", "g": "src/f.ts", "f": "src/f.ts"})
    sim = spark.createDataFrame([("f", "h", 0.95, False, 0), ("h", "f", 0.97, False, 1), ("f", "g", 1.0, True, 2), ("f", "dup", 0.99, False, 3), ("g", "h", 0.8, False, 4)], S.SIMILAR)
    assert rows(links.similar(n, sim), "id", "other", "score") == [("f", "h", 0.97), ("h", "f", 0.97)]
    call = lambda src, tgt, strategy="import_map", conf=0.95, kind="Function", line=7, ord=0: (src, src, "src/a.test.ts", 3, 5, kind, None, tgt, strategy, conf, line, ord)
    calls = spark.createDataFrame([call("t1", "f"), call("t1", "f", ord=1), call("m", "f", kind="Module", line=None), call("m", "f", kind="Module", line=8, ord=2), call("t1", "g", conf=None), call("t1", "g", strategy="fuzzy"), call("f", "g")], S.TEST_CALLS)
    assert rows(links.tested_by(n, calls), "id", "test", "name", "start_line", "top_level", "total") == [("f", "m", "a.test.ts", 8, True, 2), ("f", "t1", "t1", 3, False, 2)]


def test_folds(spark):
    kinds = {"T": "Type", "I": "Interface", "m": "Module"}
    n = nodes_of(spark, ["f", "g", "T", "I", "m"], kinds=kinds, files={"m": "src/f.ts", "f": "src/f.ts"})
    e = edges_of(spark, [("f", "T", "USAGE"), ("g", "T", "CALLS"), ("T", "I", "USAGE"), ("m", "g", "IMPORTS"), ("m", "g", "CALLS"), ("f", "g"), ("g", "m")])
    m = fold.modules(n, e)
    assert rows(m["uses"]) == [("src/f.ts", "g", "CALLS")] and rows(m["modules"])[0][1] == ["m"]
    t = fold.types(m["nodes"], m["edges"], spark.createDataFrame([("T", "I"), ("T", "T"), ("T", "x")], "source string, target string"))
    nested = {r.id: r for r in fold.nested_types(t).collect()}
    assert nested["T"].used_by == ["f"] and nested["T"].refers_to == ["I"] and nested["I"].referenced_by_types == ["T"] and nested["I"].implemented_by == ["T"]
    assert rows(t["edges"], "src", "dst") == [("f", "g")]
    assert {r.id: r.called_at_load_by for r in fold.module_links(t["nodes"], m["uses"]).collect()} == {"f": None, "g": ["src/f.ts"]}


def test_severity_cuts(spark):
    measured = spark.createDataFrame([(f"n{v}", f"f{v}", float(v)) for v in range(1, 21)], "id string, file string, blast_radius double")
    got = risk.with_severity(risk.signals(measured)).filter("severity = 'severe'")
    assert rows(got, "value") == [(19.0,), (20.0,)]
    low = measured.filter("blast_radius < 10")
    assert risk.with_severity(risk.signals(low)).filter("severity = 'severe'").count() == 0
    ties = spark.createDataFrame([(f"n{i}", "f", 12.0) for i in range(5)], "id string, file string, blast_radius double")
    assert risk.with_severity(risk.signals(ties)).filter("severity = 'severe'").count() == 5


def test_coverage(spark):
    n = spark.createDataFrame([("a", "m", 1, 4), ("b", "m", 6, 9), ("c", "m", 11, 13), ("d", "other", 1, 3), ("e", "empty", 2, 3), ("z", "m", 9, 2)], "id string, file string, start_line int, end_line int")
    lines = spark.createDataFrame([("m", x) for x in (1, 5, 6, 9, 10, 11, 12, 13)], "file string, line int")
    listed = spark.createDataFrame([("m",), ("empty",)], "file string")
    assert rows(coverage.gaps(n, listed, lines), "id", "coverage_gap") == [("a", False), ("b", False), ("c", False), ("d", None), ("e", True), ("z", False)]
    fns = spark.createDataFrame([("m", "p", 1), ("m", "q", 6), ("m", "r", 11), ("m", "two", 2), ("m", "two", 3)], "file string, name string, line int")
    hits = spark.createDataFrame([("m", "p", 0), ("m", "q", 0), ("m", "r", 1), ("m", "two", 5)], "file string, name string, hits long")
    stale = spark.createDataFrame([], "file string")
    assert [i for i, h in rows(coverage.function_hits(n, fns, hits, stale), "id", "function_hit") if h] == ["c"]
    assert not any(h for _, h in rows(coverage.function_hits(n, fns, hits, listed), "id", "function_hit"))


def test_changes(spark):
    types = spark.createDataFrame([("T", "T", "Type", "f", 1, 10), ("U", "U", "Type", "f", 20, 30), ("V", "V", "Type", "g", 1, 5), ("W", "W", "Type", "h", 1, 5)], "id string, name string, kind string, file string, start_line int, end_line int")
    used = spark.createDataFrame([("T", "a", "Function"), ("T", "b", "Function"), ("V", "a", "Function")], "type string, id string, kind string")
    changed = spark.createDataFrame([("f", 0), ("g", 1), ("h", 2)], "file string, ord long")
    listed = spark.createDataFrame([("f",), ("h",)], "file string")
    ranges = spark.createDataFrame([("f", 10, 12), ("f", 16, 15)], "file string, start int, end int")
    got = diff.changed_contracts(types, used, changed, listed, ranges)
    assert rows(got, "id", "approximate", "dependents", "dependent_ids") == [("T", False, 2, ["a", "b"]), ("V", True, 1, ["a"])]
    inner = spark.createDataFrame([("f", 2, 3), ("f", 26, 25), ("g", 4, 9)], "file string, start int, end int")
    assert rows(diff.contract_only(types, inner)) == [("f",)]
    n = spark.createDataFrame([("big", "f", 1, 50, 0), ("small", "f", 5, 9, 1), ("same", "f", 5, 9, 2)], "id string, file string, start_line int, end_line int, ord long")
    at = spark.createDataFrame([(1, "f", 7), (2, "f", 40), (3, "f", 99), (4, "g", 1)], "point int, file string, line int")
    assert rows(diff.enclosing(n, at), "point", "node_id") == [(1, "small"), (2, "big")]


def test_review_caps_affected_only(spark):
    n = spark.createDataFrame([(f"n{i:03}", f"n{i}", i) for i in range(130)], "id string, name string, blast_radius long")
    changed = spark.createDataFrame([(f"n{i:03}",) for i in range(60)], "id string")
    hops = spark.createDataFrame([(f"n{i:03}", 1) for i in range(55, 125)], "id string, hop int")
    got = review.rows(n, changed, hops, 2).collect()
    assert len(got) == 110 and got[0].hidden == 15 and min(r.blast_radius for r in got if r.hop) == 75
    nulls = spark.createDataFrame([("b", None), ("a", 1), ("c", 2)], "id string, v int")
    assert [r.id for r in review.sorted_by(nulls, "v", True).collect()] == ["c", "a", "b"] and [r.id for r in review.sorted_by(nulls, "v").collect()] == ["a", "c", "b"]
    words = spark.createDataFrame([("1", "Éa"), ("2", "eb"), ("3", "EA")], "id string, v string")
    assert [r.id for r in review.sorted_by(words, "v", text=True).collect()] == ["1", "3", "2"]


def test_two_cliques(spark):
    ids = [f"{c}{i:02}" for c in "xy" for i in range(20)]
    pairs = [(a, b) for c in "xy" for a in ids for b in ids if a < b and a[0] == b[0] == c] + [("x00", "y00")]
    n, e = nodes_of(spark, [*ids, "alone"], files={i: f"lib/{i[0]}/f.ts" for i in ids}), edges_of(spark, pairs)
    got = community.describe(n, e, traverse.cut(community.partition(n, e)))
    assert sorted(r["size"] for r in got["communities"].collect()) == [1, 20, 20]
    assert rows(got["links"], "count") == [(1,)]
    assert sorted(r.label for r in got["communities"].collect()) == ["lib/x/f.ts", "lib/y/f.ts", "unreferenced"]


def test_partition_by_component_equals_whole():
    for seed in range(40):
        r = random.Random(seed)
        blocks = [range(0, 9), range(9, 16), range(16, 24)]
        pairs = sorted({tuple(sorted(r.sample(list(b), 2))) for b in blocks for _ in range(r.randint(6, 14))})
        used = sorted({x for p in pairs for x in p})
        at = {x: i for i, x in enumerate(used)}
        whole = 2.0 * len(pairs)
        got = community.partition_component([(at[a], at[b]) for a, b in pairs], len(used), whole)
        groups = {frozenset(x for x in used if got[at[x]] == c) for c in set(got)}
        apart = set()
        for b in blocks:
            mine = [p for p in pairs if p[0] in b]
            names = sorted({x for p in mine for x in p})
            k = {x: i for i, x in enumerate(names)}
            g = community.partition_component([(k[a], k[c]) for a, c in mine], len(names), whole)
            apart |= {frozenset(x for x in names if g[k[x]] == c) for c in set(g)}
        assert groups == apart


def test_small_communities_join_without_looking_through_all():
    import time

    n = 30_000
    pairs = [(i, i + 1) for i in range(n - 1)]
    start = time.time()
    got = community.join_small(list(range(n)), pairs)
    assert time.time() - start < 20  # quadratic: minutes
    sizes = [got.count(c) for c in set(got[:400])]
    assert got[:2] == [got[0]] * 2 and min(sizes) >= 4
    # the smallest first, then the neighbour with most edges, then the larger, then the smaller label
    assert community.join_small([0, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3], [(0, 2), (1, 2), (1, 6), (1, 7)]) == [2, 3, 2, 2, 2, 2, 3, 3, 3, 3, 3]


def plain_depths(members, callees, called):
    """Walks one after the other, each over what is left."""
    left, out = set(members), {}
    starts = sorted(m for m in members if not called[m]) or [min(members, key=lambda m: (-called[m], m))]
    while left:
        start = next((s for s in starts if s in left), None) or min(left)
        level, depth = [(start, None)], 0
        left.remove(start)
        while level:
            out |= {n: (depth, p) for n, p in level}
            depth, above, level = depth + 1, [n for n, _ in level], []
            for n in above:
                new = sorted(c for c in callees.get(n, ()) if c in left)
                left -= set(new)
                level += [(c, n) for c in new]
    return out


def test_depths(spark):
    r = random.Random(8)
    nodes, edges, want = [], [], {}
    for k, (n, m) in enumerate([(9, 14), (8, 20), (6, 5), (1, 0), (5, 25)]):
        ids = [f"c{k}n{i}" for i in range(n)]
        nodes += [(i, f"c{k}") for i in ids]
        pairs = {(r.choice(ids), r.choice(ids)) for _ in range(m)} - {(i, i) for i in ids}
        if k == 4:
            pairs |= set(zip(ids, ids[1:] + ids[:1], strict=True))
        edges += sorted(pairs)
        callees = {i: [b for a, b in pairs if a == i] for i in ids}
        want |= plain_depths(ids, callees, {i: sum(b == i for _, b in pairs) for i in ids})
    members = spark.createDataFrame(nodes, "id string, community string")
    inner = community.structure(spark.createDataFrame(edges, "src string, dst string"), members)
    assert {x.id: (x.depth, x.parent) for x in layout.depths(members, inner).collect()} == want


def plain_relax(n, links, passes=4):
    slot, wide = list(range(n)), math.ceil(math.sqrt(n))
    total = lambda s: sum(w * math.dist(divmod(s[a], wide), divmod(s[b], wide)) for a, b, w in links)
    for _ in range(passes):
        for a, b in itertools.combinations(range(n), 2):
            other = slot.copy()
            other[a], other[b] = other[b], other[a]
            both = [x for x in links if {a, b} & set(x[:2])]
            ab = sum(w * math.dist(divmod(slot[a], wide), divmod(slot[b], wide)) for x, y, w in both if {x, y} == {a, b})
            if total(other) < total(slot) - 1e-9 and ab >= 0:
                slot = other
    return slot


def test_layouts(spark):
    r = random.Random(2)
    for n in (1, 2, 5, 9, 12):
        links = [(a, b, r.randint(1, 9)) for a in range(n) for b in range(a) if r.random() < 0.4]
        assert layout.relax([f"b{i}" for i in range(n)], [(f"b{a}", f"b{b}", w) for a, b, w in links]) == plain_relax(n, links)
    cards = spark.createDataFrame([("k", "r", 0, None, 0), ("k", "b", 1, "r", 0), ("k", "a", 1, "r", 0), ("k", "top", 1, "r", -3), ("k", "z", 3, "b", 0), ("k", "y", 3, "a", 0)], "block string, id string, depth int, parent string, rank int")
    sizes = spark.createDataFrame([("top", 300.0, 200.0)], "id string, width double, height double")
    places, extent = layout.layered(cards, sizes)
    assert rows(places, "id", "x", "y") == [("a", 260.0, 224.0), ("b", 260.0, 334.0), ("r", 0.0, 0.0), ("top", 260.0, 0.0), ("y", 880.0, 0.0), ("z", 880.0, 110.0)]
    assert rows(extent) == [("k", 1140.0, 444.0)]
    many = spark.createDataFrame([("k", f"n{i:02}", 0, None, 0) for i in range(10)], "block string, id string, depth int, parent string, rank int")
    assert rows(layout.layered(many, square=True)[0], "id", "x", "y")[4:6] == [("n04", 0.0, 440.0), ("n05", 260.0, 0.0)]
    assert layout.zoom_band(0.9, 0.5) == 0.5 and layout.zoom_band(0.3, 0.5) == 0.25
    assert layout.live_view(-130.0, 40.0, 0.5, 800.0, 400.0, 0.5) == (0.5, (400.0, 0.0, 1600.0, 800.0)) and layout.live_view(0, 0, 1, 0, 9, 0.5)[1] == (0.0, 0.0, 0.0, 0.0)
    cards = spark.createDataFrame([(0, 300.0, None), (1, None, None), (2, 100.0, 200.0)], "index int, width double, height double")
    assert [(x.x, x.y) for x in layout.measured_grid(cards, 2).orderBy("index").collect()] == [(0.0, 0.0), (360.0, 0.0), (0.0, 224.0)]
    pts = spark.createDataFrame([("a", 10.0, 10.0), ("b", 20.0, 20.0), ("c", 900.0, 900.0)], "id string, x double, y double")
    assert rows(layout.level_of_detail(pts, 1.0, 2.0, (0.0, 0.0, 1000.0, 1000.0)), "nodes", "full") == [(1, True), (2, False)]
    # a and b share cells up to the threshold; c is alone at once
    far = spark.createDataFrame([("a", 10.0, 10.0), ("b", 20.0, 20.0), ("c", 9000.0, 900.0)], "id string, x double, y double")
    assert layout.zoom_to_show(far, "c", 0.4, 1.0, 800, 600) == 0.4 and layout.zoom_to_show(far, "a", 0.4, 1.0, 800, 600) == 1.0 and layout.zoom_to_show(far, "a", 0.4, 1.0, 0, 0) == 0.4
    assert rows(layout.bounds_of(pts)) == [(-120.0, -45.0, 1150.0, 1000.0)]
    assert layout.fit((0.0, 0.0, 1000.0, 500.0), (1.0, 2.0), 1100.0, 1100.0) == (550.0 - 500.0, 550.0 - 250.0, 1.0)
    assert layout.fit((0.0, 0.0, 1e5, 1e5), (100.0, 200.0), 800.0, 600.0) == (400.0 - 25.0, 300.0 - 50.0, 0.25)
    assert layout.shelves([("a", 1000.0, 100.0), ("b", 300.0, 200.0), ("c", 100.0, 100.0)]) == {"a": (0.0, 0.0), "b": (0.0, 320.0), "c": (820.0, 320.0)}
    members = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("c", "c2"), ("d", "c3"), ("e", "c3"), ("u", "community:unreferenced"), ("v", "community:unreferenced")], "id string, community string")
    inner = community.structure(spark.createDataFrame([("a", "b"), ("d", "e")], "src string, dst string"), members)
    links = spark.createDataFrame([("c1", "c2", 1)], "source string, target string, count long")
    got = layout.full_layout(members, inner, links, ["c1", "c2", "c3", "community:unreferenced"], spark.createDataFrame([("t",)], "id string"), ["c3"])
    at = {x.id: (x.x, x.y) for x in got.collect()}
    assert at.keys() == {"a", "b", "c", "c3", "u", "v", "t"} and at["a"] == (0.0, 0.0) and at["b"] == (260.0, 0.0) and at["v"][0] == at["u"][0] + 260.0


def test_drill_tree():
    callees = {"r": [f"c{i:02}" for i in range(40)], "c00": ["r", "x"], "x": ["c01"]}
    of, reach = lambda n: callees.get(n, []), lambda n: 100 if n == "c39" else 0
    t = Tree.of([("r", 5)]).expand("r", of, reach)
    assert [e.id for e in t.entries if e.kind == "node"][1] == "c39" and [e.hidden for e in t.entries if e.kind == "more"] == [10]
    t = t.expand_more("r", of, reach)
    assert len([e for e in t.entries if e.kind == "node"]) == 41 and not [e for e in t.entries if e.kind == "more"]
    t = t.expand("c00", of, reach)
    assert ("ref", "r") in [(e.kind, e.id) for e in t.entries if e.parent == "c00"] and "x" in t.shown()
    assert ("ref", "c01") in [(e.kind, e.id) for e in t.entries if e.parent == "x"]
    back = t.collapse("c00")
    assert "x" not in back.shown() and back.collapse("r").shown().keys() == {"r"}
    assert back.refreshed({"r", "c05"}, lambda n: ["c05", "new"] if n == "r" else [], reach).shown().keys() == {"r", "c05", "new"}
    h = History().push("a").push("b").move(-1).push("c")
    assert h.places == ("a", "c") and h.move(5) == h
    assert toggle_pin(["a"], "a") == ("removed", []) and toggle_pin([str(i) for i in range(50)], "x")[0] == "full"
