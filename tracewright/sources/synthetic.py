"""SRC-34: a graph for benchmarks. Each node calls `fanout` earlier ones, chosen by a hash; 50 nodes a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def graph(spark: SparkSession, nodes: int, fanout: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    ids = spark.range(nodes)
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    n = ids.select(name(F.col("id")).alias("id"), name(F.col("id")).alias("name"), F.concat(F.lit("src/f"), F.floor(F.col("id") / 50).cast("string"), F.lit(".ts")).alias("file"), (F.col("id") % 50 * 10 + 1).cast("int").alias("start_line"), (F.col("id") % 50 * 10 + 9).cast("int").alias("end_line"), F.lit("Function").alias("kind"), F.lit(False).alias("is_test"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(30)).cast("double").alias("complexity"), F.lit(None).cast("double").alias("cognitive"))
    e = ids.filter("id > 0").select("id", F.explode(F.sequence(F.lit(1), F.lit(fanout))).alias("k"))
    return n, e.select(name(F.col("id")).alias("src"), name(F.pmod(F.xxhash64("id", "k", F.lit(seed)), F.col("id"))).alias("dst"), F.lit("CALLS").alias("kind"))
