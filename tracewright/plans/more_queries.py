"""Queries of the record store, review, signals, readers and layout operators over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import canvas, community, coverage, diff, entry, fold, layout, order, records, review, risk, scope
from ..sources import diffs, query_text, scans
from ..storage import apart, dealt
from . import graph_view as g
from . import sql as q
from .queries import _MODULES, _TYPES, _with, query

_GAPS = "gp AS (SELECT DISTINCT file FROM nodes WHERE starts_with(id, 'P:') AND complexity % 11 = 0)"
_RECORDS = "rec AS (SELECT id, name AS summary, complexity % 2 = 0 AS stale FROM nodes WHERE complexity % 3 = 0)"


def _gaps(n: DataFrame) -> DataFrame:
    return n.filter("id LIKE 'P:%' AND complexity % 11 = 0").select("file").distinct()


def _records(n: DataFrame) -> DataFrame:
    return n.filter("complexity % 3 = 0").select("id", F.col("name").alias("summary"), (F.col("complexity") % 2 == 0).alias("stale"))


@query("record_states", _with(q.NODES, _GAPS, _RECORDS) + "SELECT n.id, r.summary, r.stale, CASE WHEN n.file IN (SELECT file FROM gp) THEN 'coverage-gap' WHEN r.summary IS NOT NULL THEN 'summarized' ELSE 'pending' END AS status FROM nodes n LEFT JOIN rec r ON r.id = n.id")
def record_states(spark, d):
    """JOIN-27"""
    n = g.nodes(spark, d)
    return records.attach(n.select("id", "file"), _gaps(n), _records(n)).select("id", "summary", "stale", "status")


@query("record_eligible", _with(q.NODES, _GAPS, _RECORDS) + "SELECT id FROM nodes WHERE file NOT IN (SELECT file FROM gp) AND id NOT IN (SELECT id FROM rec)")
def record_eligible(spark, d):
    """FLT-32"""
    n = g.nodes(spark, d)
    return records.eligible(n.select("id", "file"), _gaps(n), _records(n)).select("id")


@query("record_patch", _with(q.NODES) + "SELECT id, file, CASE WHEN complexity % 4 = 0 THEN 'again ' || name ELSE name END AS name, CASE WHEN complexity % 4 = 0 THEN NULL ELSE complexity END AS complexity FROM nodes")
def record_patch(spark, d):
    """JOIN-32"""
    n = g.nodes(spark, d).select("id", "file", "name", "complexity")
    again = n.filter("complexity % 4 = 0").select("id", F.lit("elsewhere").alias("file"), F.concat(F.lit("again "), "name").alias("name"), F.lit(None).cast("double").alias("complexity"))
    return records.patch(n, again, ["name", "complexity"])


@query("record_lookup", _with(q.NODES, _MODULES) + "SELECT 'node' AS found, id, file FROM nodes WHERE id = 'P:1' UNION ALL SELECT 'module', id, file FROM mo WHERE id = 'P:9' UNION ALL SELECT 'type', id, file FROM nodes WHERE id = 'P:7'")
def record_lookup(spark, d):
    """JOIN-25"""
    m = fold.modules(g.nodes(spark, d), g.edges(spark, d), g.graph_rows(spark, d))
    t = fold.types(m["nodes"], m["edges"], spark.createDataFrame([], "source string, target string"), g.graph_rows(spark, d))
    found = [records.lookup(i, t["nodes"], m["modules"], t["types"]) for i in ("P:1", "P:9", "P:7", "gone")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("missing_pins", "SELECT 'P:' || l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 20) GROUP BY l_partkey")
def missing_pins(spark, d):
    """JOIN-30"""
    pins = g.table(spark, d, "lineitem").select(F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("id"))
    return review.missing(pins, g.nodes(spark, d).filter("complexity <= 20"))


@query(
    "drawn_edges",
    _with(q.NODES, q.EDGES, "vis AS (SELECT id FROM nodes WHERE NOT starts_with(id, 'C:')), hl AS (SELECT id FROM nodes WHERE complexity % 5 = 0)")
    + "SELECT src, dst, false AS regrouped, src IN (SELECT id FROM hl) OR dst IN (SELECT id FROM hl) AS highlight FROM (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM vis) AND dst IN (SELECT id FROM vis)) UNION ALL SELECT DISTINCT 'geo', src, true, src IN (SELECT id FROM hl) FROM edges WHERE starts_with(src, 'S:')",
)
def drawn_edges(spark, d):
    """JOIN-31"""
    n, e = g.nodes(spark, d), g.edges(spark, d)
    regrouped = e.filter("src LIKE 'S:%'").select(F.lit("geo").alias("src"), F.col("src").alias("dst")).distinct()
    return review.drawn_edges(e, n.filter("id NOT LIKE 'C:%'"), regrouped, n.filter("complexity % 5 = 0"))


_SEVERITY = "CASE event_id % 5 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' WHEN 3 THEN 'info' ELSE 'odd' END"
_RANK = "CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END"


def _findings(spark, d) -> DataFrame:
    return g.table(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("event_type").alias("tool"), F.expr(_SEVERITY).alias("severity"), F.col("event_id").alias("ord"))


@query("findings_summaries", f"SELECT user_id AS id, count(*) AS findings, arg_min({_SEVERITY}, ({_RANK}, event_id)) AS severity, arg_min(event_type, ({_RANK}, event_id)) AS tool FROM events GROUP BY user_id")
def findings_summaries(spark, d):
    """AGG-21"""
    return review.findings_summary(_findings(spark, d))


@query("ingested_signals", f"SELECT user_id AS node_id, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY {_RANK}, event_id) AS place FROM events WHERE event_type <> 'click'")
def ingested_signals(spark, d):
    """TOP-10"""
    rows = _findings(spark, d).withColumn("family", F.when(F.col("tool") != "click", "ingested").otherwise("deterministic"))
    return risk.ingested_order(rows).select("node_id", "ord", F.col("place").cast("long").alias("place"))


@query("visible_signals", "SELECT user_id AS node_id, count(*) AS hidden FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY user_id")
def visible_signals(spark, d):
    """FLT-29"""
    return risk.visible(_findings(spark, d).withColumnRenamed("tool", "family"), ["click", "view"])[1]


@query(
    "live_signals",
    "SELECT user_id AS node_id, event_id AS ord, 'deterministic' AS family, NULL AS text FROM events WHERE event_type = 'click' UNION ALL SELECT doc_id, 100, 'llm-judgment', 'q' || quality FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 101, 'ingested', 'toxic ' || toxic FROM labels",
)
def live_signals(spark, d):
    """JOIN-28, AGG-13"""
    cached = g.table(spark, d, "events").select(F.col("user_id").cast("long").alias("node_id"), F.col("event_id").cast("long").alias("ord"), F.when(F.col("event_type") == "click", "deterministic").otherwise("ingested").alias("family"), F.lit(None).cast("string").alias("text"))
    finding = F.array(F.struct(F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("finding"), F.lit("bot").alias("tool"), F.lit("info").alias("severity")))
    stored = g.table(spark, d, "labels").select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("quality") == 0, F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("judgment"), finding.alias("findings"))
    return risk.live(cached, stored).select("node_id", F.col("ord").cast("long").alias("ord"), "family", "text")


@query("tests_states", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'gap' WHEN p_size % 3 = 0 OR p_size % 5 > 2 THEN 'covered' WHEN p_size % 7 < 3 THEN 'unproven' ELSE 'none' END AS state FROM part")
def tests_states(spark, d):
    """AGG-23"""
    s = F.col("p_size")
    tests = F.when(s % 5 > 2, s % 5).otherwise(F.lit(0))
    return g.table(spark, d, "part").select("p_partkey", review.tests_state(s % 2 == 0, s % 3 == 0, tests, s % 7 < 3).alias("state"))


@query("first_depths", "SELECT p_brand, p_type, CAST(max(hop) AS INTEGER) AS max_hop, greatest(1, least(2, coalesce(CAST(max(hop) AS INTEGER), 1))) AS depth FROM (SELECT *, CASE WHEN p_size > 20 THEN p_size % 4 END AS hop FROM part) GROUP BY p_brand, p_type")
def first_depths(spark, d):
    """AGG-24: for each brand and type; small parts have no hop"""
    p = g.table(spark, d, "part").select("p_brand", "p_type", F.when(F.col("p_size") > 20, F.col("p_size") % 4).cast("int").alias("hop"))
    return review.first_depth(p, "p_brand", "p_type")


@query(
    "diff_summary",
    _with(q.NODES, q.EDGES, _TYPES, q.CHANGE, _MODULES)
    + "SELECT 'nodes' AS what, count(DISTINCT id) AS n FROM mp WHERE id NOT IN (SELECT id FROM ty) AND id IN (SELECT id FROM nodes WHERE file IN (SELECT file FROM changed)) UNION ALL SELECT 'contracts', count(*) FROM ty t WHERE t.file IN (SELECT file FROM changed) AND (t.file NOT IN (SELECT file FROM listed) OR EXISTS (SELECT 1 FROM ranges r WHERE r.file = t.file AND r.s <= t.end_line AND t.start_line <= r.e))",
)
def diff_summary(spark, d):
    """AGG-04, API-06"""
    c = g.change(spark, d)
    m = fold.modules(g.nodes(spark, d), g.edges(spark, d), g.graph_rows(spark, d))
    t = fold.types(m["nodes"], m["edges"], spark.createDataFrame([], "source string, target string"), g.graph_rows(spark, d))
    f = diff.summary(t["nodes"], t["types"], t["used_by"], m["modules"], c["changed"], c["listed"], c["ranges"])
    return f["nodes"].select("id").distinct().agg(F.lit("nodes").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(f["contracts"].agg(F.lit("contracts").alias("what"), F.count(F.lit(1)).alias("n")))


_IN = "(starts_with({f}, 'Brand#1/') OR {f} = 'Brand#1')"


@query("rescoped_types", _with(q.NODES, q.EDGES, _TYPES) + f"SELECT type, id FROM ub WHERE type IN (SELECT id FROM ty WHERE {_IN.format(f='file')}) AND id IN (SELECT id FROM nodes WHERE kind NOT IN ('Interface', 'Type') AND starts_with(file, 'orders/'))")
def rescoped_types(spark, d):
    """AGG-09"""
    t = fold.types(g.nodes(spark, d), g.edges(spark, d), spark.createDataFrame([], "source string, target string"), g.graph_rows(spark, d))
    return fold.rescoped(t, t["nodes"].filter("file LIKE 'orders/%'"), ["Brand#1"])["used_by"].select("type", "id").distinct()


@query("densest_group", "SELECT p_brand AS community, count(*) AS size FROM part GROUP BY p_brand ORDER BY size DESC, community LIMIT 1")
def densest_group(spark, d):
    """AGG-26"""
    return community.densest(g.table(spark, d, "part").groupBy(F.col("p_brand").alias("community")).agg(F.count(F.lit(1)).alias("size")))


@query("coverage_gap_flags", "SELECT p_partkey, p_size % 3 > 0 OR p_size % 4 > 0 AS has_gap FROM part")
def coverage_gap_flags(spark, d):
    """AGG-31, API-07"""
    p = g.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("skipped"), (F.col("p_size") % 4).alias("partial"), F.lit(1).alias("indexed"))
    return coverage.verdict(p).select("p_partkey", "has_gap")


@query("implements_rows", _with(q.NODES, q.EDGES) + "SELECT DISTINCT e.src AS source, e.dst AS target FROM (SELECT DISTINCT 'P:' || a.l_partkey AS src, 'P:' || b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber) e JOIN nodes x ON x.id = e.src AND x.kind IN ('Interface', 'Type') JOIN nodes y ON y.id = e.dst AND y.kind IN ('Interface', 'Type')")
def implements_rows(spark, d):
    """SRC-06, FLT-05"""
    i = g.table(spark, d, "lineitem")
    part = lambda c: F.concat(F.lit("P:"), F.col(c).cast("string"))
    nxt = i.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), part("l_partkey").alias("dst"))
    raw = i.select("l_orderkey", "l_linenumber", part("l_partkey").alias("src")).join(nxt, ["l_orderkey", "l_linenumber"]).select("src", "dst", F.lit("IMPLEMENTS").alias("kind"))
    return scans.implements(raw, g.nodes(spark, d)).select("source", "target").distinct()


@query("stale_sources", "SELECT p_brand || '/' || p_partkey AS file FROM part WHERE p_size % 4 = 0 OR p_size % 4 > 1")
def stale_sources(spark, d):
    """SRC-19"""
    p = g.table(spark, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("file"), "p_size")
    return coverage.stale_files(p.select("file"), p.filter("p_size % 4 != 0").select("file", (F.col("p_size") % 4).cast("double").alias("mtime")), 1.0).select("file")


@query("changed_names", "SELECT l_orderkey, file, CAST(min(ord) AS BIGINT) AS ord FROM (SELECT l_orderkey, 'f' || (l_partkey % 50) AS file, 2 * (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) AS ord FROM lineitem) GROUP BY l_orderkey, file")
def changed_names(spark, d):
    """SRC-20: the items of each order as a listing with blank lines"""
    item = g.table(spark, d, "lineitem")
    lines = dealt(item, item.count(), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit(" f"), (F.col("l_partkey") % 50).cast("string"), F.lit(" ")).alias("name"))
    listing = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "name"))).alias("x")).select("l_orderkey", F.array_join(F.transform("x", lambda r: F.concat(r["name"], F.lit("\r\n"))), "\n").alias("value"))
    return diffs.changed_files(listing, keys=["l_orderkey"])


@query("snapshot_differences", "SELECT p_name || p_partkey AS file FROM part WHERE p_size <= 10 OR p_size > 40 OR p_size % 7 = 0")
def snapshot_differences(spark, d):
    """SRC-20"""
    p = g.table(spark, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("file"), "p_size")
    before = p.filter("p_size <= 40").select("file", F.col("p_size").cast("string").alias("hash"))
    after = p.filter("p_size > 10").select("file", F.when(F.col("p_size") % 7 == 0, "new").otherwise(F.col("p_size").cast("string")).alias("hash"))
    return diffs.snapshot_changes(before, after)


@query("section_arguments", _with(q.NODES) + f"SELECT id, CASE WHEN ord % 5 = 0 THEN 'all' WHEN regexp_replace(file, '/.*$', '') IN ({', '.join(f"'{s}'" for s in g.SECTIONS)}) THEN 'section' ELSE 'unknown-section' END AS state FROM nodes")
def section_arguments(spark, d):
    """FLT-22: each node's top folder as an argument, none for each fifth"""
    return g.nodes(spark, d).select("id", scope.section_states(F.when(F.col("ord") % 5 != 0, F.substring_index("file", "/", 1)), g.SECTIONS).alias("state"))


@query("same_scopes", "SELECT p_partkey, [p_size % 2, p_size % 3] = CASE WHEN p_size % 5 = 0 THEN [p_size % 3, p_size % 2, 0] ELSE [p_size % 3, p_size % 2] END AS same FROM part")
def same_scopes(spark, d):
    """SET-05: order and length count"""
    two, three = (F.col("p_size") % k for k in (2, 3))
    other = F.when(F.col("p_size") % 5 == 0, F.array(three, two, F.lit(0))).otherwise(F.array(three, two))
    return g.table(spark, d, "part").select("p_partkey", scope.same_scopes(F.array(two, three), other).alias("same"))


@query("rejected_rows", "SELECT count(*) AS n, count(*) FILTER (p_size > 30) AS dropped FROM part")
def rejected_rows(spark, d):
    """FLT-30"""
    p = g.table(spark, d, "part")
    return scans.rejects(p, p.filter("p_size <= 30")).toDF("n", "dropped")


@query("index_gaps", "SELECT 'a' || p_partkey AS path, 'skipped' AS kind FROM part UNION ALL SELECT 'b' || p_partkey, 'skipped' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'c' || p_partkey, 'partial' FROM part")
def index_gaps(spark, d):
    """SRC-33"""
    k = F.col("p_partkey").cast("string")
    second = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(', {"path": "b'), k, F.lit('"}'))).otherwise(F.lit(", 7"))
    reply = F.concat(F.lit('{"skipped": ["a'), k, F.lit('"'), second, F.lit('], "partial": [{"path": "c'), k, F.lit('"}, {"file": "x"}]}'))
    return scans.gap_files(g.table(spark, d, "part").select(reply.alias("reply")))


@query("json_reply_rows", "SELECT p_partkey AS reply, 0 AS n, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def json_reply_rows(spark, d):
    """SRC-13"""
    row = F.concat(F.lit('[{"name": "'), F.col("p_name"), F.lit('", "size": '), F.col("p_size").cast("string"), F.lit("}]"))
    name = F.when(F.col("p_size") % 5 == 0, "rows").when(F.col("p_size") % 5 == 1, "results").when(F.col("p_size") % 5 == 2, "records").otherwise("data")
    text = F.when(F.col("p_size") % 3 == 0, row).otherwise(F.concat(F.lit('{"'), name, F.lit('": '), row, F.lit("}")))
    r = query_text.json_rows(g.table(spark, d, "part").select(F.col("p_partkey").alias("reply"), text.alias("value")), "reply")
    return r.select("reply", "n", F.col("cells")["name"].alias("name"), F.col("cells")["size"].alias("size"))


_RELATED = "rl AS (SELECT 'c' || (p_size % 20) AS a, 'c' || (p_size % 20 + 20) AS b, count(*) AS shared_reach FROM part GROUP BY 1, 2)"


def _related(spark, d) -> DataFrame:
    k = (F.col("p_size") % 20).cast("string")
    return g.table(spark, d, "part").groupBy(F.concat(F.lit("c"), k).alias("a"), F.concat(F.lit("c"), (F.col("p_size") % 20 + 20).cast("string")).alias("b")).agg(F.count(F.lit(1)).alias("shared_reach"))


@query("relation_list", f"WITH {_RELATED} SELECT a, b, shared_reach, row_number() OVER (ORDER BY shared_reach DESC, a, b) AS rank, count(*) OVER () AS total FROM rl ORDER BY rank LIMIT 50")
def relation_list(spark, d):
    """TOP-06"""
    return entry.agent_relations(_related(spark, d))


@query("relation_partners", f"WITH {_RELATED} SELECT id, shared_reach, row_number() OVER (ORDER BY shared_reach DESC, id) AS rank, count(*) OVER () AS total FROM (SELECT CASE WHEN a = 'c3' THEN b ELSE a END AS id, shared_reach FROM rl WHERE a = 'c3' OR b = 'c3') ORDER BY rank LIMIT 3")
def relation_partners(spark, d):
    """TRV-25"""
    return entry.partners(_related(spark, d), "c3")


@query("candidate_replies", "SELECT p_partkey AS id FROM part WHERE p_size % 4 <> 0 AND p_size % 5 <> 0 AND p_size % 7 < 5")
def candidate_replies(spark, d):
    """FLT-34"""
    p = g.table(spark, d, "part")
    reply = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 != 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("file"), F.when(F.col("p_size") % 7 < 5, 3).otherwise(-1).alias("reach"), F.lit(False).alias("pinned"))
    return canvas.valid_candidates(reply)[0].select("id")


@query("bot_findings_of_nodes", _with(q.NODES, "pts AS (SELECT l_orderkey, l_linenumber, file, start_line + l_linenumber AS line FROM lineitem JOIN nodes ON id = 'P:' || l_partkey)") + "SELECT p.l_orderkey || '#' || p.l_linenumber AS message, arg_min(n.id, n.ord) AS node_id, 'major' AS severity FROM (SELECT DISTINCT * FROM pts) p JOIN nodes n ON n.file = p.file AND p.line BETWEEN n.start_line AND n.end_line GROUP BY p.l_orderkey, p.l_linenumber, p.file, p.line")
def bot_findings_of_nodes(spark, d):
    """JOIN-18"""
    n, rows = g.nodes(spark, d), g.graph_rows(spark, d)
    # line items meet parts alone, so no other node goes into the first join
    at = n.filter(F.startswith("id", F.lit("P:"))).select(F.col("id").alias("nid"), "file", "start_line")
    i = g.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("nid")).join(apart(dealt(at, rows, "nid")), "nid")
    each = i.select("l_orderkey", "l_linenumber", "file", (F.col("start_line") + F.col("l_linenumber")).alias("line"))
    found = dealt(each, rows, "l_orderkey", "l_linenumber").distinct()
    found = found.select(F.xxhash64("l_orderkey", "l_linenumber", "file", "line").alias("point"), "file", "line", F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("message"), F.lit("info").alias("severity"))
    out = diff.findings_of_nodes(n, found, "pr-bot", "major", rows)
    return out.select(F.col("finding").alias("message"), "node_id", "severity")


@query(
    "measured_grids",
    "WITH c AS (SELECT p_partkey AS i, CASE WHEN p_size % 3 > 0 THEN p_size * 10.0 END AS w, CASE WHEN p_size % 3 > 0 THEN p_size * 4.0 END AS h FROM part), m AS (SELECT i, i % 12 AS col, i // 12 AS row, greatest(260, coalesce(w, (SELECT max(w) FROM c)) + 60) AS pw, greatest(110, coalesce(h, (SELECT max(h) FROM c)) + 24) AS ph FROM c), xs AS (SELECT col, coalesce(sum(max(pw)) OVER (ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM m GROUP BY col), ys AS (SELECT row, coalesce(sum(max(ph)) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM m GROUP BY row) SELECT i AS \"index\", CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM m JOIN xs USING (col) JOIN ys USING (row)",
)
def measured_grids(spark, d):
    """COM-13"""
    p = g.table(spark, d, "part")
    some = F.col("p_size") % 3 > 0
    cards = p.select(F.col("p_partkey").alias("index"), F.when(some, F.col("p_size") * 10.0).cast("double").alias("width"), F.when(some, F.col("p_size") * 4.0).cast("double").alias("height"))
    return layout.measured_grid(cards, 12).select("index", "x", "y")


@query(
    "layered_cards",
    "WITH c AS (SELECT p_brand AS block, 'n' || p_partkey AS id, p_size % 3 AS depth, p_size % 4 AS rank FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY block, depth ORDER BY rank, id) - 1 AS row FROM c), k AS (SELECT block, depth, row_number() OVER (PARTITION BY block ORDER BY depth) - 1 AS pos FROM (SELECT DISTINCT block, depth FROM c)) SELECT r.block, r.id, CAST(r.depth * 260.0 AS DOUBLE) AS x, CAST(row * 110.0 AS DOUBLE) AS y FROM r",
)
def layered_cards(spark, d):
    """COM-12"""
    p = g.table(spark, d, "part")
    cards = p.select(F.col("p_brand").alias("block"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") % 3).cast("int").alias("depth"), F.lit(None).cast("string").alias("parent"), (F.col("p_size") % 4).alias("rank"))
    return layout.layered(cards)[0]


@query("community_view", "SELECT 'P:' || p_partkey AS id FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')")
def community_view(spark, d):
    """COM-16, COM-20"""
    p = g.table(spark, d, "part")
    members = p.select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("community"))
    links = spark.createDataFrame([("Brand#1", "Brand#2", 1)], "source string, target string, count long")
    shown = spark.createDataFrame([("Brand#1",), ("Brand#2",)], "community string")
    return community.view(members, links, shown)[0].select("id")


@query("utf16_ranks", "SELECT k, row_number() OVER (ORDER BY u, k) AS place FROM (SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN '0061' WHEN 1 THEN 'D83D' WHEN 2 THEN 'FB00' ELSE 'E000' END AS u FROM part)")
def utf16_ranks(spark, d):
    """FN-01"""
    w = F.when(F.col("p_size") % 4 == 0, "a").when(F.col("p_size") % 4 == 1, "\U0001f600").when(F.col("p_size") % 4 == 2, "ﬀ").otherwise("")
    p = g.table(spark, d, "part").select(F.col("p_partkey").alias("k"), canvas.utf16_order(w).alias("key"))
    return order.places(p, [F.col("key"), F.col("k")]).select("k", "place")
