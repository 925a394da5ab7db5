"""Scans at once with limits; cut replies; absent and corrupt reports."""

import os
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewright.sources import evidence, lcov, query_text

SCHEMA = "id long, name string"


def source(spark, name, n=5, limit=60.0, sleep_ms=0, fail=False):
    def load():
        df = spark.range(n).select("id", F.lit(name).alias("name"))
        if sleep_ms:
            df = df.filter(F.expr(f"length(coalesce(java_method('java.lang.Thread', 'sleep', CAST({sleep_ms} + id * 0 AS BIGINT)), 'x')) > 0"))
        return df.withColumn("name", F.raise_error(F.lit("no such thing"))) if fail else df

    return evidence.Scan(name, SCHEMA, load, limit)


def test_a_slow_scan_holds_up_no_other(spark):
    sources = [source(spark, "slow", limit=2, sleep_ms=20_000), source(spark, "quick"), source(spark, "bad", fail=True), evidence.Scan("gone", SCHEMA, lambda: spark.read.parquet("/nowhere/x")), evidence.Scan("other", SCHEMA, lambda: spark.range(3).withColumnRenamed("id", "else"))]
    began = time.time()
    found = evidence.fetch(spark, [source(spark, "first"), source(spark, "second")], sources)
    assert time.time() - began < 18
    assert {k: df.count() for k, df in found.frames.items()} == {"first": 5, "second": 5, "slow": 0, "quick": 5, "bad": 0, "gone": 0, "other": 0}
    assert all(df.dtypes == [("id", "bigint"), ("name", "string")] for df in found.frames.values())
    assert rows(found.warnings, "name", "kind") == [("bad", "failed"), ("gone", "absent"), ("other", "failed"), ("slow", "timed-out")]
    assert "no such thing" in found.warnings.filter("name = 'bad'").first().message
    # tags of the run don't stay, so later work isn't interrupted
    assert spark.range(10).count() == 10 and not spark.sparkContext.getJobTags()


def test_a_mandatory_failure_is_raised(spark):
    with pytest.raises(Exception, match="no such thing"):
        evidence.fetch(spark, [source(spark, "first", fail=True)], [])
    assert evidence.fetch(spark, [], []).frames == {}


def test_reports_absent_corrupt_and_fine(spark, tmp_path):
    good, bad, odd = (str(tmp_path / x) for x in ("good", "bad", "odd"))
    open(good, "w").write("TN:\nSF:a.ts\nDA:1,2\nend_of_record\n")
    open(bad, "wb").write(b"SF:\xff\xfe a\nDA:1,1")
    open(odd, "w").write("")
    os.utime(good, (1_000_000, 1_000_000))
    got = lcov.load(spark, [good, bad, odd, str(tmp_path / "none")])
    assert {(os.path.basename(r.path), r.status, r.text is not None) for r in got.collect()} == {("good", "ok", True), ("bad", "corrupt", False), ("odd", "corrupt", False), ("none", "absent", False)}
    assert got.filter("status = 'ok'").selectExpr("unix_seconds(modified) AS s").first().s == 1_000_000
    assert rows(lcov.parse(lcov.lines_of(got))["lines"]) == [("a.ts", 1, 2)]
    assert rows(lcov.load(spark, [])) == []


def test_cut_replies(spark):
    texts = ["rows: 2 (cols: a)\nx\ny", "rows: 2 (cols: a)\nx\ny\ntotal: 2", "rows: 2 (cols: a)\nx\ny\ntotal: 5", "rows: 100000 (cols: a)", 'rows: 1 (cols: a)\nx\n{"truncated": true}', "rows: 1 (cols: a)\nhas_more=false", "rows: 1 (cols: a)\nnext_cursor: 7", "total: 9", None, ""]
    got = query_text.states(spark.createDataFrame(list(enumerate(texts)), "id int, value string"), "id")
    assert rows(got, "id", "state") == [(0, "ok"), (1, "ok"), (2, "cut"), (3, "cut"), (4, "cut"), (5, "ok"), (6, "cut"), (7, "malformed"), (8, "malformed"), (9, "malformed")]
    assert got.filter("id = 2").first().reason == "2 of 5 rows"
