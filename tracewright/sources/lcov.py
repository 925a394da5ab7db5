"""LCOV reports: SRC-15 to SRC-18. Lines need their order; it is kept within each report by a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import report_path
from ..storage import dealt, hadoop_path


def read(spark: SparkSession, path: str) -> DataFrame:
    """report, n and line of every line of the files at path; reports are read whole, one row each."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), F.split("value", "\r?\n").alias("lines"))
    return text.select("report", F.posexplode("lines").alias("n", "line"))


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC-16: a row for each report: path (as asked for), report, modified, status and text.

    status is ok, absent, or corrupt (empty, no UTF-8, or no source file named); only an ok one has text.
    modified comes with the listing, before the content, so a report that changes meanwhile looks
    older and never newer. A path may be a folder, which is read with all below it.
    """
    there, gone = [], []
    for p in paths:
        path, fs = hadoop_path(spark, p)
        (there if fs.exists(path) else gone).append(p)
    absent = spark.createDataFrame([(p,) for p in gone], "path string").select("path", F.lit(None).cast("string").alias("report"), F.lit(None).cast("timestamp").alias("modified"), F.lit("absent").alias("status"), F.lit(None).cast("string").alias("text"))
    out = absent
    for p in there:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
        text = F.try_validate_utf8(F.col("content").cast("string"))
        ok = F.coalesce(text.rlike(r"(?m)^\s*SF:\s*\S"), F.lit(False))
        out = out.unionByName(found.select(F.lit(p).alias("path"), F.col("path").alias("report"), F.col("modificationTime").alias("modified"), F.when(ok, "ok").otherwise("corrupt").alias("status"), F.when(ok, text).alias("text")))
    # files without a byte give no row of their own
    asked = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
    return asked.join(out, "path", "left").withColumn("status", F.coalesce("status", F.lit("corrupt")))


def lines_of(loaded: DataFrame) -> DataFrame:
    """report, n and line of the reports that are ok."""
    return loaded.filter("status = 'ok'").select("report", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))


def parse(lines: DataFrame, root: str = "", rows: int | None = None) -> dict[str, DataFrame]:
    """SRC-15: files (file), lines (file, line, hits), functions (file, name, line), hits (file, name, hits).

    lines: report, n, line. A record belongs to the SF line before it, up to end_of_record; blocks of
    one file are merged. Other records are ignored. rows: how many lines there are at most, for dealt().
    """
    kinds = ("SF:", "DA:", "FN:", "FNDA:")
    told = lines.select("report", "n", F.trim("line").alias("line")).filter(reduce(Column.__or__, [F.startswith("line", F.lit(k)) for k in kinds], F.col("line") == "end_of_record"))
    sf = told.filter("line LIKE 'SF:%'").select(report_path(F.trim(F.substring("line", 4, 1 << 20)), root).alias("file"))
    # SF begins a block and end_of_record ends it: a line's file is what the last of both names. Reports are sorted by a
    # hash first, since their names have much in common; equal lines of a file are parsed once
    mark = F.when(F.startswith("line", F.lit("SF:")) | (F.col("line") == "end_of_record"), F.col("line"))
    upto = Window.partitionBy(F.xxhash64("report"), "report").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = dealt(told.filter("report IS NOT NULL"), rows, "report").select("line", F.last(mark, ignorenulls=True).over(upto).alias("sf"))
    body = within.filter("sf LIKE 'SF:%' AND line != sf").groupBy("sf", "line").agg(F.count(F.lit(1)).alias("n"))
    body = body.select(F.trim(F.substring("sf", 4, 1 << 20)).alias("file"), "line", "n").withColumn("file", report_path("file", root))
    of = lambda pattern, group, kind: F.regexp_extract("line", pattern, group).try_cast(kind)
    da = r"^DA:(\d+),(\d+)"
    lines_ = body.filter("line LIKE 'DA:%'").select("file", of(da, 1, "int").alias("line"), (of(da, 2, "long") * F.col("n")).alias("hits")).filter("line IS NOT NULL AND hits IS NOT NULL")
    fn = r"^FN:(\d+),(?:\d+,)?(.+)$"
    functions = body.filter(F.col("line").rlike(fn)).select("file", F.trim(F.regexp_extract("line", fn, 2)).alias("name"), of(fn, 1, "int").alias("line")).distinct()
    fnda = r"^FNDA:(\d+),(.+)$"
    hits = body.filter(F.col("line").rlike(fnda)).select("file", F.trim(F.regexp_extract("line", fnda, 2)).alias("name"), (of(fnda, 1, "long") * F.col("n")).alias("hits"))
    return {
        "files": sf.select("file").distinct(),
        "lines": lines_.groupBy("file", "line").agg(F.sum("hits").alias("hits")),
        "functions": functions,
        "hits": hits.groupBy("file", "name").agg(F.sum("hits").alias("hits")),
    }


def covered(report: dict[str, DataFrame]) -> DataFrame:
    return report["lines"].filter("hits > 0").select("file", "line")
