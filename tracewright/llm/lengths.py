"""Token counts by an exact length histogram.

Documents are counted by their encoded length. Sums over the histogram from a length upwards answer
totals, quantiles and truncated totals for every context limit, without reading a text again.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_runs, pick, small_batches, tidy, written

WIDTH = 1024


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs), counted within each batch of rows; lengths recur."""

    def run(batches):
        import pyarrow as pa

        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            found: dict[int, int] = {}
            for _, texts in byte_runs(batch.column(0)):
                for data in texts:
                    n = len(encode(data.decode("utf-8"))) if data else 0
                    found[n] = found.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["length", "n_docs"])

    small_batches(docs.sparkSession)
    return pick(docs, text_col).mapInArrow(tidy(run), "length long, n_docs long")


def histogram(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Documents of each encoded length, with sums from that length upwards.

    Returns for each length that occurs: length, n_docs, n_tokens, docs_from and tokens_from (of this
    length or longer), truncated_total (all tokens if texts are cut to this length), docs_upto (of
    this length or shorter). All long. Null and empty texts have length 0; very long ones are encoded
    whole; repeated rows count each; ids and other columns are not read. Empty table: no rows.
    The histogram is written once, so texts are encoded once. Sums run within ranges of WIDTH lengths; only a row for each range meets in one task.
    """
    h = written(encoded_lengths(docs, path, pattern, text_col).groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "lengths")
    h = h.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / WIDTH).alias("band"))
    up = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = h.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    whole = Window.partitionBy()
    bands = bands.select("band", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"{c}_above") for c in "dt"], *[F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"])
    within = Window.partitionBy("band").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = h.select("*", F.sum("n_docs").over(within).alias("d_in"), F.sum("n_tokens").over(within).alias("t_in")).join(bands, "band")
    docs_from, tokens_from = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("t_all") - tokens_from + F.col("length") * docs_from).alias("truncated_total"),
        (F.col("d_all") - docs_from + F.col("n_docs")).alias("docs_upto"),
    )


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens that are left if every text is cut to `limit` tokens, for any limit."""
    below = F.when(F.col("length") < limit, F.col("n_tokens")).otherwise(F.lit(limit) * F.col("n_docs"))
    return hist.agg(F.coalesce(F.sum(below), F.lit(0))).first()[0]


def quantile(hist: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share q of all documents doesn't exceed; None without documents."""
    total = F.col("docs_from") + F.col("docs_upto") - F.col("n_docs")
    return hist.filter(F.col("docs_upto") >= F.ceil(F.lit(q) * total)).agg(F.min("length")).first()[0]
