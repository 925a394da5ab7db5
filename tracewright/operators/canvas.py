"""What is drawn and said about the map: JOIN-23, JOIN-29, TOP-15, FLT-34, FN-01, UDF-07, UDF-08, UDF-10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranked import top_k

#: Shown of ambiguous names, neighbours and findings; the rest is a number.
SHOWN = {"matches": 20, "neighbours": 50, "findings": 3}


def folded_elements(nodes: DataFrame, types: DataFrame, used_by: DataFrame, modules: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOIN-23: folded types and modules as cards (id, kind) and their links (src, dst) to map nodes, each once, no loops.

    A module is drawn under its file. Links to what isn't on the map are left out."""
    ids = nodes.select("id").distinct()
    cards = types.select("id", "kind").unionByName(modules.select(F.col("file").alias("id"), F.lit("Module").alias("kind"))).distinct()
    by_type = used_by.select(F.col("id").alias("src"), F.col("type").alias("dst")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    by_module = uses.select(F.col("file").alias("src"), F.col("id").alias("dst")).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return cards, by_type.select("src", "dst").unionByName(by_module.select("src", "dst")).filter("src != dst").distinct()


def attach_signals(annotated: DataFrame, signals: DataFrame) -> DataFrame:
    """JOIN-29: nodes with their signals nested in order, joined by id. Nodes of one id get the same signals."""
    nested = signals.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "type", "value"))).alias("signals"))
    empty = F.array().cast(dict(nested.dtypes)["signals"])
    return annotated.join(nested, "id", "left").withColumn("signals", F.coalesce("signals", empty))


def unique_ids(nodes: DataFrame) -> DataFrame:
    """JOIN-29's check: ids that more than one row has, with how many."""
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def shown(df: DataFrame, what: str, by: list[str], order: list[Column | str]) -> DataFrame:
    """TOP-15: the first rows that are shown, with the total."""
    return top_k(df, by, order, SHOWN[what])


def valid_candidates(reply: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-34: candidates with an id, a name, a file and a reach that isn't negative; and the ids of pins that are hidden (reach null)."""
    good = F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("file").isNotNull() & (F.col("reach") >= 0)
    return reply.filter(good), reply.filter("pinned AND reach IS NULL").select("id")


def utf16_order(text: Column | str) -> Column:
    """FN-01: a sort key by UTF-16 code units; plain strings sort by code point, which differs beyond the basic plane."""
    return F.hex(F.encode(text, "UTF-16BE"))


def parsed(raw: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """UDF-07, UDF-08: a row parser is a function from a frame to a frame of as many rows or fewer; with the number dropped."""
    good = parse(raw)
    return good, raw.agg(F.count(F.lit(1)).alias("n")).crossJoin(good.agg(F.count(F.lit(1)).alias("m"))).select((F.col("n") - F.col("m")).alias("dropped"))


def sized(cards: DataFrame, sizes: DataFrame) -> DataFrame:
    """UDF-10: card sizes are a table; cards without one are not measured."""
    return cards.join(sizes.select("id", "width", "height"), "id", "left")
