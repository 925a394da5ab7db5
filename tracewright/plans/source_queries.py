"""Queries over sources that may be slow, absent, cut or damaged, made from the given tables, and their SQL."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import evidence, lcov, query_text, scans
from ..storage import fresh
from . import graph_view as g
from . import sql as q
from .queries import query


@query(
    "evidence_scans",
    f"""WITH {q.NODES}, {q.EDGES}, {q.FILES}, {q.CALLS}
    SELECT 'nodes' AS name, count(*) AS n, NULL AS kind FROM nodes UNION ALL SELECT 'edges', count(*), NULL FROM edges UNION ALL SELECT 'files', count(*), NULL FROM files
    UNION ALL SELECT 'calls', count(*), NULL FROM calls WHERE strategy <> 'suffix_match' AND source IN (SELECT id FROM nodes WHERE test)
    UNION ALL SELECT 'similar', 0, 'absent' UNION ALL SELECT 'co_changes', 0, 'failed'""",
)
def evidence_scans(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09, SRC-10: three mandatory scans, then three at once, of which one is absent and one fails on its rows"""
    E = evidence.Scan
    must = [
        E("nodes", "id string, name string, file string", lambda: scans.node_rows(g.nodes(spark, d))),
        E("edges", "src string, dst string, kind string", lambda: scans.edge_rows(g.edges(spark, d))),
        E("files", "file string, change_count long", lambda: scans.file_rows(g.files(spark, d))),
    ]
    may = [
        E("calls", "source string, target string, strategy string", lambda: scans.test_calls(g.test_calls(spark, d)), 600),
        E("similar", "a string, b string", lambda: spark.read.parquet(f"{d}/similar-pairs-that-nobody-wrote"), 600),
        E("co_changes", "file string, score double", lambda: g.table(spark, d, "part").select(F.col("p_brand").alias("file"), F.raise_error(F.concat(F.lit("no score for "), "p_brand")).cast("double").alias("score")), 600),
    ]
    found = evidence.fetch(spark, must, may)
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in found.frames.items()])
    return counts.join(found.warnings.select("name", "kind"), "name", "left")


_TEXT = """CASE p_partkey % 7 WHEN 0 THEN 'rows: 1 (cols: name)' || chr(10) || '"a"' WHEN 1 THEN 'rows: 1 (cols: name)' || chr(10) || '"a"' || chr(10) || 'total: ' || p_size WHEN 2 THEN 'rows: 100000 (cols: name)' || chr(10) || 'a'
    WHEN 3 THEN 'rows: 2 (cols: name)' || chr(10) || 'a' || chr(10) || 'has_more: TRUE' WHEN 4 THEN 'rows: 1 (cols: name)' || chr(10) || 'a' || chr(10) || '{"nextCursor": "x"}' WHEN 5 THEN 'error: ' || p_name END"""


@query(
    "reply_states",
    """SELECT p_partkey AS reply,
        CASE WHEN p_partkey % 7 IN (5, 6) THEN 'malformed' WHEN p_partkey % 7 = 0 OR (p_partkey % 7 = 1 AND p_size <= 1) THEN 'ok' ELSE 'cut' END AS state,
        CASE p_partkey % 7 WHEN 1 THEN CASE WHEN p_size > 1 THEN '1 of ' || p_size || ' rows' END WHEN 2 THEN '100000 rows, the most there can be' WHEN 3 THEN 'more rows than these' WHEN 4 THEN 'more rows than these' END AS reason,
        CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 100000 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS rows_told,
        CASE p_partkey % 7 WHEN 5 THEN 0 WHEN 6 THEN 0 WHEN 3 THEN 1 ELSE 1 END AS rows_read
    FROM part""",
)
def reply_states(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14: each part as a reply, whole, cut in one of four ways, or no reply at all"""
    return query_text.states(g.table(spark, d, "part").select(F.col("p_partkey").alias("reply"), F.expr(_TEXT).alias("value")), "reply")


@query(
    "report_states",
    """SELECT p_brand AS brand, CASE WHEN n % 7 = 0 THEN 'absent' WHEN n % 5 = 0 THEN 'corrupt' ELSE 'ok' END AS status, CASE WHEN n % 7 <> 0 AND n % 5 <> 0 THEN files ELSE 0 END AS files
    FROM (SELECT p_brand, regexp_extract(p_brand, '[0-9]+')::INTEGER AS n, count(DISTINCT p_type) AS files FROM part GROUP BY ALL)""",
)
def report_states(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16: a coverage report for each brand, some of them absent, some without any source file"""
    part = g.table(spark, d, "part").withColumn("n", F.regexp_extract("p_brand", "[0-9]+", 0).cast("int"))
    root = fresh(spark, "reports")
    body = F.concat(F.lit("SF:"), "p_type", F.lit("\nDA:1,1\nend_of_record"))
    there = part.filter("n % 7 <> 0").select("p_brand", F.when(F.col("n") % 5 == 0, "DA:1,1").otherwise(body).alias("value"))
    there.repartition("p_brand").write.partitionBy("p_brand").text(root)
    brands = [r["p_brand"] for r in part.select("p_brand").distinct().collect()]  # a fixed set of names
    brand = F.url_decode(F.regexp_extract("path", "p_brand=([^/]*)", 1))
    loaded = lcov.load(spark, [f"{root}/p_brand={quote(b)}" for b in brands])
    files = lcov.lines_of(loaded).filter("line LIKE 'SF:%'").groupBy("report").agg(F.count_distinct("line").alias("files"))
    return loaded.join(files, "report", "left").select(brand.alias("brand"), "status", F.coalesce("files", F.lit(0)).alias("files"))
