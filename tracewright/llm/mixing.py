"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token totals are raked until
their sums agree with the target share of each source, each language and each topic. A cell's
documents are then sampled with one probability, calibrated so that the sample's expected tokens
follow the raked shares and sum to the wanted part of all.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MARGINS = ("source", "lang", "topic")
#: Without given targets: shares are raised to these powers, which lifts small groups.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
NONE = "(none)"
#: Up to so many cells are raked on the driver; more are raked as a table.
MOST_CELLS = 50_000
ROUNDS, CLOSE = 200, 1e-10


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return (F.size(F.split(F.concat(F.lit("a "), text, F.lit(" a")), r"[\x20\x09-\x0D]+")) - 2).cast("long")


def topic_of(text: Column) -> Column:
    """The first that holds: legal (license words), contact (an @), markup (over 2 % symbols), list (lines of under 40 characters on average), prose."""
    low, size = F.lower(text), F.length(text)
    symbols = size - F.length(F.translate(text, "#*$%&|<>", ""))
    lines = size - F.length(F.replace(text, F.lit("\n"))) + 1
    return (
        F.when(F.contains(low, F.lit("licens")) | F.contains(low, F.lit("rights reserved")), "legal")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(symbols * 50 > size, "markup")
        .when(lines * 40 > size, "list")
        .otherwise("prose")
    )


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """id, source, lang, topic, tokens and u of each row. u in [0, 1) depends on the id, and for rows without one on the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), text)
    u = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    return docs.select(F.col(id_col).alias("id"), name(source_col).alias("source"), name(lang_col).alias("lang"), topic_of(text).alias("topic"), n_tokens(text).alias("tokens"), u.alias("u"), *keep)


def tempered(totals: Mapping[str, float], power: float) -> dict[str, float]:
    """Target shares: each one's share of all tokens raised to the power, scaled to sum to 1."""
    whole = sum(totals.values()) or 1.0
    raised = {k: (v / whole) ** power if v > 0 else 0.0 for k, v in totals.items()}
    return {k: v / (sum(raised.values()) or 1.0) for k, v in raised.items()}


def _warn(rounds: int, off: float) -> None:
    warnings.warn(f"raking stopped after {rounds} rounds, a share still off by {off:.3g}", RuntimeWarning, stacklevel=3)


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Shares of cells whose sums by each coding agree with the targets, as far as they can.

    Each step scales the cells of each group so that the group's sum is its target. A group without
    tokens can't be raised, so targets are taken over the groups that have some.
    """
    share = tokens / (tokens.sum() or 1.0)
    off = float("inf")
    for _ in range(rounds):
        off = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, share, len(target))
            want = np.where(now > 0, target, 0.0)
            want = want / (want.sum() or 1.0)
            factor = np.divide(want, now, out=np.zeros_like(want), where=now > 0)
            off = max(off, float(np.abs(now - want).max(initial=0.0)))
            share = share * factor[code]
        if off < close:
            break
    else:
        _warn(rounds, off)
    return share


def calibrate(tokens: np.ndarray, share: np.ndarray, part: float) -> np.ndarray:
    """Probability of each cell: min(1, c times share over tokens), with c such that the expected tokens are `part` of all."""
    ratio = np.divide(share, tokens, out=np.zeros_like(share), where=tokens > 0)
    want = part * tokens.sum()
    if not want or not (ratio > 0).any():
        return np.ones_like(share) if part >= 1 else np.zeros_like(share)
    order = np.argsort(-ratio, kind="stable")
    full = np.concatenate([[0.0], np.cumsum(tokens[order])])
    rest = np.concatenate([np.cumsum(share[order][::-1])[::-1], [0.0]])
    # with the first k cells taken whole, c = (want - full[k]) / rest[k]; the right k is the first whose next cell stays below 1
    for k in range(len(order)):
        c = max(0.0, want - full[k]) / rest[k] if rest[k] > 0 else 0.0
        if c * ratio[order[k]] <= 1:
            break
    else:
        c = 1 / ratio[ratio > 0].min()
    return np.minimum(1.0, c * ratio)


def _fit_here(cells: list, targets: Mapping[str, Mapping[str, float]] | None, part: float) -> list[tuple]:
    cells = sorted(cells, key=lambda r: tuple(r[m] for m in MARGINS))
    tokens = np.array([r["tokens"] for r in cells], float)
    codes, wanted = [], []
    for m in MARGINS:
        values = sorted({r[m] for r in cells})
        place = {v: i for i, v in enumerate(values)}
        code = np.array([place[r[m]] for r in cells], np.int64)
        given = (targets or {}).get(m) or tempered(dict(zip(values, np.bincount(code, tokens, len(values)), strict=True)), POWERS[m])
        codes.append(code)
        wanted.append(np.array([given.get(v, 0.0) for v in values], float))
    share = rake(tokens, codes, wanted)
    p = calibrate(tokens, share, part)
    return [(*[r[m] for m in MARGINS], float(s), float(x)) for r, s, x in zip(cells, share, p, strict=True)]


def _fit_as_table(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, part: float, rounds: int = ROUNDS) -> DataFrame:
    """The same for cells too many for the driver: a join and a sum for each margin of each round, written after each."""
    spark = cells.sparkSession
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = cells.withColumn("share", F.col("tokens") / F.lit(float(whole)))
    wanted = {}
    for m in MARGINS:
        if targets and targets.get(m):
            wanted[m] = spark.createDataFrame(list(targets[m].items()), f"{m} string, target double")
        else:
            wanted[m] = cells.groupBy(m).agg(F.sum("share").alias("s")).select(m, F.when(F.col("s") > 0, F.pow("s", F.lit(POWERS[m]))).otherwise(F.lit(0.0)).alias("target"))
    off = float("inf")
    for _ in range(rounds):
        off = 0.0
        for m in MARGINS:
            now = cells.groupBy(m).agg(F.sum("share").alias("now")).join(wanted[m], m, "left").withColumn("target", F.when(F.col("now") > 0, F.coalesce("target", F.lit(0.0))).otherwise(F.lit(0.0)))
            total = now.agg(F.sum("target")).first()[0] or 1.0
            now = now.select(m, "now", (F.col("target") / F.lit(total)).alias("want"))
            off = max(off, now.agg(F.max(F.abs(F.col("now") - F.col("want")))).first()[0] or 0.0)
            factor = now.select(m, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(F.lit(0.0)).alias("factor"))
            cells = cells.join(factor, m).withColumn("share", F.col("share") * F.col("factor")).drop("factor")
        cells = written(cells, "cells")
        if off < CLOSE:
            break
    else:
        _warn(rounds, off)
    ratio = F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")).otherwise(F.lit(0.0))
    low, high = 0.0, (cells.agg(F.max(F.when(ratio > 0, 1 / ratio))).first()[0] or 0.0)
    for _ in range(60):
        c = (low + high) / 2
        got = cells.agg(F.sum(F.least(F.lit(1.0), F.lit(c) * ratio) * F.col("tokens"))).first()[0] or 0.0
        low, high = (c, high) if got < part * whole else (low, c)
    return cells.select(*MARGINS, "share", F.least(F.lit(1.0), F.lit(high) * ratio).alias("p"))


def fit(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, part: float = 0.8, most_cells: int = MOST_CELLS) -> tuple[DataFrame, bool]:
    """source, lang, topic, share and p of each cell, and whether the table is small enough to broadcast."""
    cells = rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    here = cells.limit(most_cells + 1).collect()
    if len(here) > most_cells:
        return _fit_as_table(written(cells, "cells"), targets, part), False
    schema = ", ".join(f"{m} string" for m in MARGINS) + ", share double, p double"
    return rows.sparkSession.createDataFrame(_fit_here(here, targets, part), schema), True


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, part: float = 0.8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", most_cells: int = MOST_CELLS) -> DataFrame:
    """Each row of docs with its cell, probability and fate.

    targets: for each of source, lang and topic the wanted shares; without, tempered shares of the
    data itself. part: of all tokens, how many to keep on average. Returns id_col, source, lang,
    topic (null as "(none)"), n_tokens long, cell_share and p double, kept boolean. Null text: no
    tokens; a cell without tokens has p 0, or 1 if all tokens are wanted. Rows of the same id share
    their fate; rows without an id are told apart by their texts. Very long texts count by all their
    words. Empty table: no rows. Columns not named are not read.
    """
    rows = written(labelled(docs, id_col, text_col, source_col, lang_col), "labelled")
    cells, small = fit(rows, targets, part, most_cells)
    out = rows.join(F.broadcast(cells) if small else cells, list(MARGINS), "left")
    return out.select(F.col("id").alias(id_col), *MARGINS, F.col("tokens").alias("n_tokens"), F.col("share").alias("cell_share"), "p", (F.col("u") < F.col("p")).alias("kept"))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, part: float = 0.8, most_cells: int = MOST_CELLS) -> DataFrame:
    """The rows of docs that mix() keeps, with their own columns, whatever their names; texts are not shuffled.

    docs: doc_id, text, source, lang and others. Nulls, empty texts, repeated rows and empty tables as in mix().
    """
    names = [f"in_{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names)
    own = labelled(rows, at["doc_id"], at["text"], at["source"], at["lang"], keep=names)
    cells, small = fit(own, targets, part, most_cells)
    joined = own.join(F.broadcast(cells) if small else cells, list(MARGINS), "left")
    return joined.filter(F.col("u") < F.col("p")).select(*[F.col(n).alias(c) for c, n in at.items()])
