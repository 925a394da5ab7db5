"""The backend's text tables: SRC-11 to SRC-14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BACKEND_ROWS_MAX, REPLY_HEADER


def tokens(line):
    """SRC-12: the tokens of a row: JSON strings, decoded, or runs without blanks."""
    found = F.regexp_extract_all(line, F.lit(r'("(?:\\.|[^"\\])*"|\S+)'), F.lit(1))
    return F.transform(found, lambda t: F.when(F.startswith(t, F.lit('"')), F.coalesce(F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"], t)).otherwise(t))


def rows(replies: DataFrame, key: str, column: str = "value") -> DataFrame:
    """SRC-11: key, n and cells (a map from column to text; - is null) of replies that start with
    "rows: N (cols: ...)"; rows of another number of tokens are dropped. At most N rows count."""
    head = REPLY_HEADER
    lines = F.split(column, "\r?\n")
    r = replies.filter(F.col(column).rlike(head)).select(key, F.regexp_extract(column, head, 1).cast("int").alias("count"), F.split(F.trim(F.regexp_extract(column, head, 2)), r"[\s,]+").alias("cols"), F.posexplode(F.slice(lines, 2, F.size(lines))).alias("n", "line"))
    r = r.filter("n < count").withColumn("tokens", tokens(F.col("line"))).filter("size(tokens) = size(cols)")
    return r.select(key, "n", F.map_from_arrays("cols", F.transform("tokens", lambda t: F.when(t != "-", t))).alias("cells"))


def json_rows(replies: DataFrame, key: str, column: str = "value") -> DataFrame:
    """SRC-13: the same from JSON: an array, or an object's rows, results, records or data; values as text."""
    v = F.try_parse_json(F.col(column))
    lists = F.coalesce(*[F.try_variant_get(v, f"$.{f}", "array<map<string,string>>") for f in ("rows", "results", "records", "data")], F.try_variant_get(v, "$", "array<map<string,string>>"))
    return replies.select(key, F.posexplode(lists).alias("n", "cells"))


def truncation(text: Column) -> Column:
    """SRC-14: why a reply may be cut, or null: fewer rows than its total, as many as the backend ever gives, or a mark that there are more."""
    number = lambda word: F.regexp_extract(text, rf"(?m)^{word}:\s*(\d+)", 1).try_cast("long")
    got, whole = number("rows"), number("total")
    more = text.rlike(r"(?i)\b(?:has_more|truncated)\b[\"']?\s*[:=]\s*[\"']?true\b") | text.rlike(r"(?i)\bnext_?cursor\b")
    ceiling = F.lit(BACKEND_ROWS_MAX)
    return (
        F.when(whole > got, F.concat_ws(" ", got, F.lit("of"), whole, F.lit("rows")))
        .when(got >= ceiling, F.concat_ws(" ", got, F.lit("rows, the most there can be")))
        .when(more, F.lit("more rows than these"))
    )


def states(replies: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Key, state (ok, cut or malformed: no header), reason, and rows told and rows that can be read."""
    text = F.col(column)
    read = rows(replies, key, column).groupBy(key).agg(F.count("*").alias("rows_read"))
    told = F.regexp_extract(text, REPLY_HEADER, 1).try_cast("long")
    reason = truncation(text)
    state = F.when(text.isNull() | ~text.rlike(REPLY_HEADER), "malformed").when(reason.isNotNull(), "cut").otherwise("ok")
    return replies.select(key, state.alias("state"), reason.alias("reason"), told.alias("rows_told")).join(read, key, "left").fillna(0, ["rows_read"])
