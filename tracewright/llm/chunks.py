"""Exact dedup by content-defined chunk recipes.

A text is cut where its own bytes say so, each chunk is named by a 64-bit hash, and a document
becomes the ordered list of its chunks' names: its recipe. Only texts whose recipes agree are read a
second time, to compare the bytes of chunks of the same name; should two differ, they get identifiers
of their own. Then equal lists of verified identifiers are equal texts. Only suspects' chunks are
moved, each distinct one of a task once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, byte_runs, may_have, pick, small_batches, tidy, written

LEAST, USUAL, MOST = 512, 2048, 8192


def normalised(data: bytes) -> bytes:
    """Each run of ASCII white space replaced by one space, those at the ends too."""
    core = b" ".join(data.split())
    if not data:
        return core
    if not core:
        return b" "
    return (b" " if data[0] in BLANKS else b"") + core + (b" " if data[-1] in BLANKS else b"")


def cuts(data: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """Ends of the chunks. A cut depends on the eight bytes before it; least and most bound the chunks' sizes."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = np.zeros(n - 7, np.uint32)
    for k in range(8):
        h = h * np.uint32(0x01000193) + x[k : n - 7 + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ends = (np.flatnonzero((h >> np.uint32(12)) % np.uint32(usual - least) == 0) + 8).tolist()
    out, start, i = [], 0, 0
    while n - start > least:
        while i < len(ends) and ends[i] < start + least:
            i += 1
        start = min(ends[i] if i < len(ends) else n, start + most, n)
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunk(data: bytes, hash_bits: int = 64) -> list[tuple[int, bytes]]:
    """Name and bytes of each chunk. hash_bits below 64 makes collisions, for tests."""
    out, start, drop = [], 0, 64 - hash_bits
    for end in cuts(data):
        piece = data[start:end]
        name = xxhash.xxh3_64_intdigest(piece) >> drop
        out.append((name - (1 << 64) if name >> 63 else name, piece))
        start = end
    return out


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """id, sha (SHA-256 of the normalised text) and recipe (chunk names in order) of each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            shas, lists = [], []
            for _, texts in byte_runs(batch.column(1)):
                for data in texts:
                    data = normalised(data or b"")
                    shas.append(hashlib.sha256(data).digest())
                    lists.append([name for name, _ in chunk(data, hash_bits)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "sha", "recipe"])

    kind = dict(docs.dtypes)[id_col]
    return pick(docs, id_col, text_col).mapInArrow(tidy(run), f"id {kind}, sha binary, recipe array<long>")


def _chunk_rows(texts: DataFrame, hash_bits: int, with_place: bool) -> DataFrame:
    """name and bytes of the chunks of a text column; with_place adds the text's sha and the chunk's position."""

    def run(batches):
        import pyarrow as pa

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())] + ([pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int32())] if with_place else []), names=["name", "bytes"] + (["sha", "place"] if with_place else []))

        for batch in batches:
            for _, part in byte_runs(batch.column(0)):
                rows = {}
                for data in part:
                    data = normalised(data or b"")
                    sha = hashlib.sha256(data).digest() if with_place else b""
                    rows.update(((name, piece, sha, i) if with_place else (name, piece), None) for i, (name, piece) in enumerate(chunk(data, hash_bits)))
                if rows:
                    yield batch_of(list(rows))

    return texts.mapInArrow(tidy(run), "name long, bytes binary" + (", sha binary, place int" if with_place else ""))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """Of rows with equal normalised texts, the one with the smallest id stays.

    Returns for each row: id_col, keep_id, group_size long, kept, text_sha256. Null text: as the
    empty text. Null ids come last; of several rows with the smallest id exactly one stays. Empty
    texts have the empty recipe and equal each other. Very long texts are many chunks of at most MOST
    bytes. Repeated rows are copies of each other. Empty table: no rows. Other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    rows = written(recipes(docs, id_col, text_col, hash_bits).withColumn("row", F.monotonically_increasing_id()), "recipes")
    alike = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    suspects = written(rows.join(alike.select("recipe"), "recipe", "left_semi").select("id").distinct(), "suspects")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = may_have(texts, suspects, "id").select("text")
    clashes = written(_chunk_rows(texts, hash_bits, False).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"), "clashes")
    key = ["recipe"]
    if not clashes.isEmpty():
        # chunks of one name but other bytes: number the bytes within the name, and add the numbers to the recipes
        placed = _chunk_rows(texts, hash_bits, True).join(clashes, "name", "left_semi")
        numbers = placed.select("name", "bytes").distinct().groupBy("name").agg(F.array_sort(F.collect_list("bytes")).alias("all"))
        own = placed.join(numbers, "name").select("sha", "place", F.array_position("all", F.col("bytes")).alias("number")).distinct()
        own = own.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("place", "number"))).alias("numbers"))
        rows = written(rows.join(own, "sha", "left").withColumn("numbers", F.coalesce("numbers", F.array().cast("array<struct<place:int,number:bigint>>"))), "numbered")
        key.append("numbers")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first")
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1")
    out = rows.join(groups, key, "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
