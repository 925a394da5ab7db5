import os

from conftest import rows

from tracewright import schema as S
from tracewright.functions import paths, text
from tracewright.operators import records
from tracewright.sources import diffs, findings, lcov, query_text, scans, synthetic
from tracewright.streaming import jobs
from pyspark.sql import functions as F

LCOV = """TN:
SF:./mod.mjs
FN:1,p
FN:6,9,q,r
FNDA:0,p
FNDA:1,q,r
DA:1,1
DA:2,0
end_of_record
DA:99,1
SF:/root/mod.mjs
DA:2,3
end_of_record
"""

DIFF = """diff --git a/x.ts b/x.ts
--- a/x.ts
+++ b/x.ts
@@ -5 +5 @@
-old
+++ b/not a header
@@ -10,0 +11,2 @@
+a
+b
@@ -20,3 +22,0 @@
-a
-b
-c
diff --git a/with space.ts b/with space.ts
--- /dev/null
+++ b/with space.ts
@@ -0,0 +1,3 @@
+1
+2
+3
diff --git a/gone.ts b/gone.ts
--- a/gone.ts
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


def test_lcov(spark, tmp_path):
    (tmp_path / "lcov.info").write_text(LCOV)
    got = lcov.parse(lcov.read(spark, str(tmp_path)), "/root")
    assert rows(got["files"]) == [("mod.mjs",)]
    assert rows(got["lines"]) == [("mod.mjs", 1, 1), ("mod.mjs", 2, 3)]
    assert rows(got["functions"]) == [("mod.mjs", "p", 1), ("mod.mjs", "q,r", 6)]
    assert rows(got["hits"]) == [("mod.mjs", "p", 0), ("mod.mjs", "q,r", 1)]


def test_diff(spark):
    assert diffs.hunks(DIFF) == {"x.ts": [(5, 5), (11, 12), (23, 22)], "with space.ts": [(1, 3)]}
    df = spark.createDataFrame([(DIFF,), (None,), ("",)], "value string")
    listed, ranges = diffs.changed_lines(df)
    assert rows(listed) == [("with space.ts",), ("x.ts",)] and ranges.count() == 4
    names = spark.createDataFrame([(" b \n\na\nb\n",)], "value string")
    assert rows(diffs.changed_files(names)) == [("a", 2), ("b", 0)]


def test_query_text(spark):
    reply = 'rows: 6  (cols: id name isTest)\na "n \\"x\\"" "true"\nb - "1"\nshort row\nc d e f\ntotal: 6'
    df = spark.createDataFrame([(1, reply), (2, "nothing")], "k int, value string")
    got = [(r.n, r.cells) for r in query_text.rows(df, "k").orderBy("n").collect()]
    assert got == [(0, {"id": "a", "name": 'n "x"', "isTest": "true"}), (1, {"id": "b", "name": None, "isTest": "1"})]
    js = spark.createDataFrame([(1, '{"rows": [{"a": 1, "b": "x"}]}'), (2, '[{"a": true}]'), (3, "no")], "k int, value string")
    assert [(r.k, r.cells) for r in query_text.json_rows(js, "k").orderBy("k").collect()] == [(1, {"a": "1", "b": "x"}), (2, {"a": "true"})]


def test_findings(spark):
    js = spark.createDataFrame([('{"findings": [{"file": "a", "line": 3, "severity": "high", "message": "m"}, {"file": "a", "line": "3", "severity": "x", "message": "m"}]}',), ('[{"file": "b", "line": 1, "severity": "s", "message": "t"}, 5]',), ("bad",)], "value string")
    assert rows(findings.from_json(js), "file", "line", "severity") == [("a", 3, "high"), ("b", 1, "s")]
    md = "Risk level: Medium\n```\nkey issues to review\n- `no.ts:1`\n```\n### Key issues to review\n* `a.ts:3` bad\n2. `b.ts` on line 9\n- nothing\n- c.ts:4 bare\n# next\n- `d.ts:1`"
    df = spark.createDataFrame([(1, md)], "k int, value string")
    assert rows(findings.from_markdown(df, "k"), "file", "line", "severity") == [("a.ts", 3, "major"), ("b.ts", 9, "major"), ("c.ts", 4, "major")]


def test_paths(spark):
    want = {"src/a.test.ts": True, "src/Latest.java": False, "FooTest.java": True, "FooIT.kt": True, "a/tests/b.ts": True, "/home/tests/b.ts": False, "../tests/b.ts": False, "x/My.Tests/b.cs": True, "scripts/test-loader.mjs": True, "lib/setupTests.ts": True, "conftest.py": True, "src/latest/x.ts": False, "": False, "a/../tests/b.ts": True}
    df = spark.createDataFrame(list(want.items()), "file string, want boolean")
    assert df.filter(paths.is_test_path("file") != F.col("want")).collect() == []
    sup = spark.createDataFrame([("lib/setupTests.ts",), ("a/__mocks__/x.ts",), ("a.test.ts",)], "file string")
    assert [r[0] for r in sup.select(paths.is_test_support("file")).collect()] == [True, True, False]
    d = spark.createDataFrame([("a.ts",), ("/a.ts",), ("x/y/a.ts",)], "file string")
    assert [r[0] for r in d.select(paths.directory("file")).collect()] == [".", ".", "x/y"]
    n = spark.createDataFrame([("3",), ("0",), ("NaN",), ("Infinity",), (None,), ("2.5",)], "v string")
    assert [r[0] for r in n.select(paths.line_number("v")).collect()] == [3.0, None, None, None, None, 2.5]
    s = spark.createDataFrame([([" a//b/ ", "", "a/b", "c\\d"],)], "p array<string>")
    assert s.select(paths.normal_scope("p")).first()[0] == ["a/b", "c/d"]


def test_texts(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert [val(text.elapsed_text(F.lit(x))) for x in (12, 999.5, 1550, 61_000, 3_720_000, -5, float("nan"))] == ["12ms", "1s", "1s", "1m 01s", "1h 02m", "0ms", "—"]
    assert [val(text.age_text(F.lit(x))) for x in (float("nan"), -1, 59_999, 60_000, 3_600_000, 86_400_000 * 365, 86_400_000 * 366, float("inf"))] == ["just now", "just now", "just now", "1 min ago", "1 h ago", "365 d ago", "over a year ago", "over a year ago"]
    assert [val(text.age_tick(F.lit(x))) for x in (-5, 0, 59_999.5, 90_000, float("inf"))] == [60_000, 60_000, 1, 30_000, 60_000]
    assert [val(text.count_text(F.lit(x))) for x in (1234567, -1, None, float("nan"), float("inf"))] == ["1,234,567", "—", "—", "—", "—"]
    assert val(text.collapsed(F.lit("\u00a0a\u2003 b\ufeff"))) == "a b"
    assert val(text.floor2_text(F.lit(0.999))) == "0.99" and val(text.floor2_text(F.lit(0.29))) == "0.29"
    assert val(text.mapped_severity(F.lit(" Critical "))) == "blocker" and val(text.mapped_severity(F.lit(None).cast("string"))) == "info"
    assert val(text.source_range(F.lit("a\r\nb\rc"), F.lit(2), F.lit(3))) == "b\nc" and val(text.source_range(F.lit("a"), F.lit(1), F.lit(2))) is None
    assert val(text.change_text(F.lit(0), F.lit(1), F.lit(0))) == "0 changed Nodes · top-level code changed in 1 file" and val(text.change_text(F.lit(0), F.lit(0), F.lit(1))) == "1 contract changed"
    assert val(text.clipped(F.lit("x" * 9000))) == "x" * 8000 + "\n… (truncated)"


def test_records(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "id int, s string, t string")
    new = spark.createDataFrame([(1, None, "B", None), (3, "n", None, None), (2, None, None, ["s"])], "id int, s string, t string, cleared array<string>")
    assert rows(records.merge(old, new, "id", ["s", "t"])) == [(1, "a", "B"), (2, None, None), (3, "n", None)]


def test_record_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "id string, text string, stale boolean"
    os.makedirs(src)
    for part in ([("a", "x", None, 1), ("b", "y", None, 2)], [("a", None, True, 3), ("b", "z", None, 4)]):
        spark.createDataFrame(part, schema + ", seq long").coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(schema + ", seq long").option("maxFilesPerTrigger", 1).json(src)
        jobs.record_sink(stream, out, "id", schema, cp, once=True).awaitTermination()
    assert rows(jobs.read_records(spark, out, schema)) == [("a", "x", True), ("b", "z", None)]
    seen = []
    stream = spark.readStream.schema(schema + ", seq long").json(src)
    jobs.progress_sink(stream, lambda n, part: seen.append(len(part)), cp + "2", most=3, once=True).awaitTermination()
    assert sum(seen) == 4 and max(seen) <= 3


def test_stream_helpers(spark):
    req = spark.createDataFrame([("k", 1, False, "a"), ("k", 3, False, "c"), ("k", 2, True, "b")], "key string, seq int, force boolean, v string")
    assert rows(jobs.latest(req, "key")) == [("k", 3, True, "c")]
    out = spark.createDataFrame([("ok",)] * 4 + [("degenerate",)] * 2, "kind string")
    assert rows(jobs.degenerate_rate(out)) == [(6, 2, True)]
    n, e = synthetic.graph(spark, 120, 3)
    assert n.count() == 120 and e.count() == 357 and scans.edge_rows(e, n).count() == 357
    gaps = spark.createDataFrame([('{"skipped": ["a", {"path": "b"}], "partial": [{"path": "c"}, 3]}',), ("x",)], "reply string")
    assert rows(scans.gap_files(gaps)) == [("a", "skipped"), ("b", "skipped"), ("c", "partial")]
