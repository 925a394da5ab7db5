"""Queries of the path and text functions, over the standard tables with odd values worked in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import paths, text
from . import graph_view as g
from .queries import query

_NAN, _INF = "CAST('nan' AS DOUBLE)", "CAST('infinity' AS DOUBLE)"
#: White space as DuckDB's expressions take it.
_S = f"[{S.SPACES}]"


def _odd(i: str, value: str) -> str:
    """SQL of a number with no number, both infinities, a negative one and a null among its values."""
    return f"CASE {i} % 11 WHEN 0 THEN {_NAN} WHEN 1 THEN {_INF} WHEN 2 THEN -{_INF} WHEN 3 THEN -({value}) WHEN 4 THEN NULL ELSE {value} END"


def _odd_column(i: str, value: str) -> Column:
    k = F.col(i) % 11
    return F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).when(k == 3, -F.expr(value)).when(k == 4, F.lit(None).cast("double")).otherwise(F.expr(value)).cast("double")


_GAP = "chr(160) || chr(8195) || ' ' || chr(9) || chr(10)"


@query("whitespace_collapse", f"SELECT conv_id, turn, regexp_replace(regexp_replace(replace(chr(65279) || ' ' || text || chr(12288), ' ', {_GAP}), '{_S}+', ' ', 'g'), '^ | $', '', 'g') AS text FROM conversations")
def whitespace_collapse(spark, d):
    """FN-03"""
    gap = "\u00a0\u2003 \t\n"
    told = F.replace(F.concat(F.lit("\ufeff "), "text", F.lit("\u3000")), F.lit(" "), F.lit(gap))
    return g.table(spark, d, "conversations").select("conv_id", "turn", text.collapsed(told).alias("text"))


_CENTS = "CAST(round(c_acctbal * 100) AS DOUBLE)"


@query("format_counts", f"SELECT c_custkey, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) OR v < 0 THEN '—' ELSE format('{{:,}}', CAST(floor(v) AS BIGINT)) END AS shown, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) OR v < 0 THEN '— Nodes' ELSE format('{{:,}}', CAST(floor(v) AS BIGINT)) || CASE WHEN v = 1 THEN ' Node' ELSE ' Nodes' END END AS counted FROM (SELECT c_custkey, {_odd('c_custkey', f'CASE c_custkey % 13 WHEN 5 THEN 1 ELSE abs({_CENTS}) END')} AS v FROM customer)")
def format_counts(spark, d):
    """FN-07"""
    v = _odd_column("c_custkey", f"CASE c_custkey % 13 WHEN 5 THEN 1 ELSE abs({_CENTS}) END")
    return g.table(spark, d, "customer").select("c_custkey", text.count_text(v).alias("shown"), text.counted(v, "Node", "Nodes").alias("counted"))


@query(
    "elapsed_texts",
    f"""SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN '—' WHEN w < 1000 THEN w || 'ms' WHEN s < 60 THEN s || 's'
    WHEN s < 3600 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END AS elapsed
    FROM (SELECT *, w // 1000 AS s FROM (SELECT *, CASE WHEN v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) THEN CAST(floor(greatest(v, 0) + 0.5) AS BIGINT) END AS w FROM (SELECT event_id, {_odd('event_id', '(event_id * 7919 % 100003) * (event_id % 97 + 1) + event_id % 4 * 0.25')} AS v FROM events)))""",
)
def elapsed_texts(spark, d):
    """FN-08"""
    v = _odd_column("event_id", "(event_id * 7919 % 100003) * (event_id % 97 + 1) + event_id % 4 * 0.25D")
    return g.table(spark, d, "events").select("event_id", text.elapsed_text(v).alias("elapsed"))


_AGE = "(event_id * 7919 % 100003) * (event_id % 400 + 1) * 1000.0"


@query(
    "age_texts",
    f"""SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR v < 60000 THEN 'just now' WHEN v >= 366 * 86400000.0 THEN 'over a year ago' WHEN v < 3600000 THEN CAST(floor(v / 60000) AS BIGINT) || ' min ago' WHEN v < 86400000 THEN CAST(floor(v / 3600000) AS BIGINT) || ' h ago' ELSE CAST(floor(v / 86400000) AS BIGINT) || ' d ago' END AS age,
    CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 60000.0 WHEN v < 60000 THEN greatest(1, least(60000, 60000 - v)) WHEN v < 3600000 THEN 60000 - v % 60000 WHEN v < 86400000 THEN least(60000, 3600000 - v % 3600000) ELSE least(60000, 86400000 - v % 86400000) END AS tick
    FROM (SELECT event_id, {_odd('event_id', _AGE)} AS v FROM events)""",
)
def age_texts(spark, d):
    """FN-09"""
    v = _odd_column("event_id", _AGE.replace("1000.0", "1000.0D"))
    return g.table(spark, d, "events").select("event_id", text.age_text(v).alias("age"), text.age_tick(v).alias("tick"))


@query("severity_vocab", "SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'blocker' WHEN 'purchase' THEN 'major' WHEN 'signup' THEN 'minor' ELSE 'info' END AS severity, CASE event_type WHEN 'error' THEN 'blocker' WHEN 'purchase' THEN 'minor' WHEN 'signup' THEN 'major' ELSE 'info' END AS pr_severity FROM events")
def severity_vocab(spark, d):
    """FN-11"""
    native = F.create_map(F.lit("error"), F.lit("\tCritical\n"), F.lit("purchase"), F.lit("HIGH\u00a0"), F.lit("signup"), F.lit("medium "))
    pr = F.create_map(F.lit("error"), F.lit(" HIGH"), F.lit("purchase"), F.lit("low\n"), F.lit("signup"), F.lit("Moderate"))
    e = g.table(spark, d, "events")
    return e.select("event_id", "event_type", text.mapped_severity(F.try_element_at(native, "event_type")).alias("severity"), text.mapped_severity(F.try_element_at(pr, "event_type"), S.PR_BOT_SEVERITY).alias("pr_severity"))


@query("source_clips", r"SELECT doc_id, md5(CASE WHEN length(text) > 8000 THEN left(text, 8000) || chr(10) || '… (truncated)' ELSE text END) AS clipped FROM documents")
def source_clips(spark, d):
    """SRC-30"""
    return g.table(spark, d, "documents").select("doc_id", F.md5(text.clipped("text")).alias("clipped"))


_ROWS = "SELECT p_partkey, 'mod.' || CASE p_size % 3 WHEN 0 THEN 'A.' WHEN 1 THEN 'B.' ELSE '' END || p_type AS id, CASE WHEN p_size % 7 = 0 THEN p_name ELSE p_type END AS name, CAST(p_size AS INTEGER) AS start_line, p_brand || '.ts' AS loc, p_size % 5 AS card FROM part"


@query(
    "row_locations",
    f"""SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY card, name, loc) < 2 THEN loc WHEN count(*) OVER (PARTITION BY card, name, loc, symbol) < 2 THEN loc || ' (' || symbol || ')' ELSE loc || ' (' || symbol || ', line ' || start_line || ')' END AS location
    FROM (SELECT *, CASE WHEN suffix(id, '.' || name) THEN split_part(id, '.', -2) || '.' || name ELSE name END AS symbol FROM ({_ROWS}))""",
)
def row_locations(spark, d):
    """FN-05"""
    p = g.table(spark, d, "part")
    p = p.select("p_partkey", F.concat(F.lit("mod."), F.when(F.col("p_size") % 3 == 0, "A.").when(F.col("p_size") % 3 == 1, "B.").otherwise(""), "p_type").alias("id"), F.when(F.col("p_size") % 7 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("name"), F.col("p_size").cast("int").alias("start_line"), F.concat("p_brand", F.lit(".ts")).alias("loc"), (F.col("p_size") % 5).alias("card"))
    return text.row_locations(p, ["card"], F.col("loc")).select("p_partkey", "location")


@query("candidate_locations", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'src/' || p_brand || '.x' ELSE 'src/' || p_brand || '.x' || p_type END AS location FROM part")
def candidate_locations(spark, d):
    """FN-06"""
    p = g.table(spark, d, "part")
    at = F.concat(F.lit("src/"), "p_brand", F.lit(".x"), F.when(F.col("p_size") % 2 == 0, ".").otherwise(""), "p_type")
    return p.select("p_partkey", text.location_text("p_type", at).alias("location"))


_FORMS = "CASE p_size % 6 WHEN 0 THEN './' || p_brand || '/a.ts' WHEN 1 THEN '/' || p_brand || '/b/a.ts/' WHEN 2 THEN p_brand || '.ts' WHEN 3 THEN p_brand || chr(92) || 'c' || chr(92) || 'a.ts' WHEN 4 THEN './a.ts' ELSE '../' || p_brand || '/a.ts' END"


@query("module_lines", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_brand || '/' WHEN 1 THEN p_brand || '/b/' WHEN 3 THEN p_brand || '/c/' WHEN 5 THEN '../' || p_brand || '/' END AS module FROM part")
def module_lines(spark, d):
    """FN-04"""
    return g.table(spark, d, "part").select("p_partkey", paths.module_line(F.expr(_FORMS.replace("chr(92)", "char(92)"))).alias("module"))


@query(
    "relative_paths",
    """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'src/' || p_brand || '.ts' WHEN 1 THEN '../other/' || p_brand || '.ts' WHEN 2 THEN './a/' || p_brand || '.ts' WHEN 3 THEN 'b/' || p_brand || '.ts' WHEN 4 THEN '../../' || p_brand WHEN 5 THEN '../x' || p_brand ELSE '' END AS file,
    CASE p_size % 7 WHEN 0 THEN '/home/me/proj/src/' || p_brand || '.ts' WHEN 1 THEN '/home/me/other//' || p_brand || '.ts' WHEN 2 THEN './a//' || p_brand || '.ts' WHEN 3 THEN 'b' || chr(92) || p_brand || '.ts' WHEN 4 THEN '/home/' || p_brand || '/' WHEN 5 THEN '/home/me/proj/../x' || p_brand ELSE '/home/me/proj/' END AS raw FROM part""",
)
def relative_paths(spark, d):
    """FLT-09, FLT-10"""
    raw = F.expr("CASE p_size % 7 WHEN 0 THEN '/home/me/proj/src/' || p_brand || '.ts' WHEN 1 THEN '/home/me/other//' || p_brand || '.ts' WHEN 2 THEN './a//' || p_brand || '.ts' WHEN 3 THEN 'b' || char(92) || p_brand || '.ts' WHEN 4 THEN '/home/' || p_brand || '/' WHEN 5 THEN '/home/me/proj/../x' || p_brand ELSE '/home/me/proj/' END")
    return g.table(spark, d, "part").select("p_partkey", paths.safe_relative(raw, "/home/me/proj").alias("file"), paths.safe_relative(raw, None).alias("raw"))


@query(
    "change_texts",
    """SELECT p_partkey, concat_ws(' · ', CASE WHEN c > 0 THEN c || CASE WHEN c = 1 THEN ' contract' ELSE ' contracts' END || ' changed' END, CASE WHEN n > 0 OR c = 0 THEN n || CASE WHEN n = 1 THEN ' changed Node' ELSE ' changed Nodes' END END, CASE WHEN f > 0 THEN 'top-level code changed in ' || f || CASE WHEN f = 1 THEN ' file' ELSE ' files' END END) AS told,
    CASE WHEN n + c + f > 0 THEN p_brand || '/: ' || concat_ws(' · ', CASE WHEN n > 0 THEN format('{:,}', n) || CASE WHEN n = 1 THEN ' changed Node' ELSE ' changed Nodes' END END, CASE WHEN c > 0 THEN c || CASE WHEN c = 1 THEN ' contract' ELSE ' contracts' END || ' changed' END, CASE WHEN f > 0 THEN 'top-level code changed in ' || f || CASE WHEN f = 1 THEN ' file' ELSE ' files' END END) END AS elsewhere
    FROM (SELECT p_partkey, p_brand, p_size % 3 * (1 + p_partkey % 2 * 999) AS n, p_size % 4 AS c, p_partkey % 3 AS f FROM part)""",
)
def change_texts(spark, d):
    """FN-18"""
    p = g.table(spark, d, "part").select("p_partkey", "p_brand", F.expr("p_size % 3 * (1 + p_partkey % 2 * 999)").alias("n"), F.expr("p_size % 4").alias("c"), F.expr("p_partkey % 3").alias("f"))
    n, c, f = (F.col(x) for x in "ncf")
    return p.select("p_partkey", text.change_text(n, f, c).alias("told"), text.elsewhere_text(F.col("p_brand"), n, c, f).alias("elsewhere"))


@query(
    "coverage_verdicts",
    """SELECT p_partkey, CASE WHEN s + q = 0 THEN 'full coverage' ELSE concat_ws(', ', CASE WHEN q > 0 THEN q || CASE WHEN q = 1 THEN ' file' ELSE ' files' END || ' partially parsed' END, CASE WHEN s > 0 THEN s || CASE WHEN s = 1 THEN ' file' ELSE ' files' END || ' skipped' END) END
    || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE format(' ({:,}/{:,} indexed Nodes, {:,}/{:,} edges expected)', p_partkey, p_partkey + s, p_partkey * 3, p_partkey * 3 + q) END AS verdict
    FROM (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_size % 3 AS s, p_size % 4 AS q FROM part)""",
)
def coverage_verdicts(spark, d):
    """FN-19"""
    p = g.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.expr("p_size % 3").alias("s"), F.expr("p_size % 4").alias("q"))
    k, s, q = (F.col(x) for x in ("p_partkey", "s", "q"))
    odd = lambda c: F.when(k % 2 != 0, c)
    return p.select("p_partkey", text.coverage_text(s, q, k, k * 3, odd(k + s), odd(k * 3 + q)).alias("verdict"))


@query("guarded_floors", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, printf('%.2f', floor(l_discount * 3.7 * 100 + 0.000000001) / 100) AS shown FROM (SELECT * REPLACE (CAST(l_discount AS DOUBLE) AS l_discount) FROM lineitem)")
def guarded_floors(spark, d):
    """FN-10"""
    return g.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.floor2_text(F.col("l_discount").cast("double") * F.lit(3.7)).alias("shown"))


@query("valid_hops", f"SELECT event_id, coalesce(v >= 1 AND NOT isnan(v) AND NOT isinf(v) AND v = floor(v), false) AS ok FROM (SELECT event_id, {_odd('event_id', 'event_id % 9 * 0.5')} AS v FROM events)")
def valid_hops(spark, d):
    """FN-14"""
    return g.table(spark, d, "events").select("event_id", text.positive_integer(_odd_column("event_id", "event_id % 9 * 0.5D")).alias("ok"))


#: Paths with what they are: test code, and support of tests.
_FILES = [
    ("src/a.test.ts", True, False), ("src/Latest.java", False, False), ("pkg/FooTest.java", True, False), ("FooIT.kt", True, False), ("a/tests/b.ts", True, False), ("/home/tests/b.ts", False, False), ("../tests/b.ts", False, False),
    ("x/My.Tests/b.cs", True, False), ("scripts/test-loader.mjs", True, True), ("lib/setupTests.ts", True, True), ("conftest.py", True, True), ("a/__mocks__/x.ts", True, True), ("src/latest/x.ts", False, False), ("lib/Test-Utils.JSX", True, True),
    ("a/../tests/b.ts", True, False), ("jobs/test_run.py", True, False), ("jobs/testrun.py", False, False), ("go/x_test.go", True, False), ("spec/x_spec.rb", True, False), ("cypress/run.ts", True, False), ("C:\\tests\\b.ts", False, False),
]


def _cases(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("test_path_predicate", f"SELECT p_partkey, {_cases('p_partkey', [str(t or i % 2 == 0).lower() for i, (_, t, _) in enumerate(_FILES)])} AS is_test, {_cases('p_partkey', [str(s).lower() for _, _, s in _FILES])} AS is_support FROM part")
def test_path_predicate(spark, d):
    """FLT-11 to FLT-14"""
    k = F.col("p_partkey") % len(_FILES)
    file = F.element_at(F.array(*[F.lit(f) for f, _, _ in _FILES]), (k + 1).cast("int"))
    return g.table(spark, d, "part").select("p_partkey", paths.is_test_node(file, k % 2 == 0).alias("is_test"), paths.is_test_support(file).alias("is_support"))


@query("scope_entries", "SELECT p_partkey, p_brand || '/x,' || p_type || CASE WHEN p_size % 2 = 0 THEN '' ELSE ',z' END AS scope FROM part")
def scope_entries(spark, d):
    """FLT-33"""
    entries = F.array(F.concat(F.lit("  "), "p_brand", F.lit("//x/ ")), F.lit(""), F.col("p_type"), F.concat("p_brand", F.lit("\\x")), F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit("/"))).otherwise("z"))
    return g.table(spark, d, "part").select("p_partkey", F.array_join(paths.normal_scope(entries), ",").alias("scope"))
