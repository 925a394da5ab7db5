"""Findings of review bots: SRC-25 to SRC-28."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import file_line, mapped_severity, risk_word


def from_json(reports: DataFrame, column: str = "value") -> DataFrame:
    """SRC-25: report, ord, file, line, severity, message of a JSON array of findings, or of an object's findings; items
    with a field missing or of another type are dropped."""
    v = F.try_parse_json(F.col(column))
    items = F.coalesce(F.try_variant_get(v, "$.findings", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    each = reports.select(F.monotonically_increasing_id().alias("report"), F.posexplode(items).alias("ord", "x"))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("x", f"$.{f}", "variant"))
    text = lambda f: F.when(kind(f) == "STRING", F.try_variant_get("x", f"$.{f}", "string"))
    line = F.when(kind("line").isin("BIGINT", "DOUBLE") | F.startswith(kind("line"), F.lit("DECIMAL")), F.try_variant_get("x", "$.line", "int"))
    return each.select("report", "ord", text("file").alias("file"), line.alias("line"), text("severity").alias("severity"), text("message").alias("message")).dropna(subset=["file", "line", "severity", "message"])


def fence_mask(lines: DataFrame, by: str, n: str, line: str) -> DataFrame:
    """SRC-28: lines with fenced: inside a fenced block, its marks included."""
    mark = F.col(line).rlike(S.FENCE_MARK)
    upto = F.sum(mark.cast("int")).over(Window.partitionBy(by).orderBy(n))
    return lines.withColumn("fenced", mark | (upto % 2 == 1))


def from_markdown(reviews: DataFrame, key: str, column: str = "value") -> DataFrame:
    """SRC-26: key, n, file, line, severity, message of the bullets below a "key issues to review" line, up to the next
    heading; bullets without a place are dropped, and all have the severity of the review's risk.

    Each line carries the number of the last line that opened the list and of the last that closed one."""
    lines = reviews.select(key, mapped_severity(risk_word(column), S.PR_BOT_SEVERITY).alias("severity"), F.posexplode(F.split(column, "\r?\n")).alias("n", "text"))
    whole = Window.partitionBy(key)
    opened = F.min(F.when(F.col("text").rlike(S.ISSUES_START), F.col("n"))).over(whole)
    told = fence_mask(lines, key, "n", "text").filter("NOT fenced").withColumn("opened", opened)
    closed = F.min(F.when((F.col("n") > F.col("opened")) & F.col("text").rlike(S.ISSUES_END), F.col("n"))).over(whole)
    items = told.withColumn("closed", closed).filter("n > opened AND (closed IS NULL OR n < closed)").withColumn("message", F.trim(F.regexp_extract("text", S.ISSUE_BULLET, 1)))
    return items.filter("message != ''").withColumn("at", file_line("message")).filter("at IS NOT NULL").select(key, "n", F.col("at.file").alias("file"), F.col("at.line").alias("line"), "severity", "message")
