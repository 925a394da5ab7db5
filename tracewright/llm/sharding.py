"""Sharding by fixed virtual slots.

A record's hash puts it into one of thousands of slots, for good. A slot map says which shard a slot
belongs to; it is a small versioned table, and rebalancing edits it: it moves or swaps whole slots
between the heaviest and the lightest shard, by the bytes counted for each slot. Built-in functions
only; the one thing brought to the driver is a row for each slot, a number fixed beforehand.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

N_SLOTS = 8192
OVERHEAD = 16
#: Rows equal in id and text share a slot up to so many.
REPEATS = 16
#: Keys of such repeats are broadcast up to so many (16 MB at most); beyond that they are joined, each dealt over SALTS.
MOST_BROADCAST, SALTS = 1 << 20, 64


def text_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def text_crc(text: str | Column) -> Column:
    """Unsigned CRC-32 of the text's UTF-8 bytes; a null text counts as the empty one (0)."""
    return F.crc32(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def slot_of(n_slots: int, *keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots).cast("long")).cast("int")


def _looked_up(values: list[int], at: Column, kind: str) -> Column:
    """values[at], with the values as one constant of the plan."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), at + 1)


@dataclass(frozen=True)
class SlotMap:
    """Which shard each slot belongs to."""

    version: int
    n_shards: int
    shard: tuple[int, ...]

    @classmethod
    def first(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(0, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def of(self, slot: Column) -> Column:
        return _looked_up(list(self.shard), slot, "int")

    def frame(self, spark: SparkSession) -> DataFrame:
        slot = F.col("id").cast("int")
        return spark.range(0, len(self.shard), 1, 1).select(slot.alias("slot"), self.of(slot).alias("shard"), F.lit(self.n_shards).alias("n_shards"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the table at path; a version once written is never changed, so of two runs that save one at once the later fails."""
        self.frame(spark).write.mode("errorifexists").parquet(f"{path}/version={self.version:08d}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """That version, or the latest whole one."""
        version = max(v for v, whole in versions(spark, path).items() if whole) if version is None else version
        rows = spark.read.parquet(f"{path}/version={version:08d}").select("slot", "shard", "n_shards").orderBy("slot").collect()
        return cls(version, rows[0][2], tuple(r[1] for r in rows))

    def rebalance(self, weight: list[int], n_shards: int | None = None, tolerance: float = 0.0005) -> SlotMap:
        """The next version: slots of shards that are gone are dealt out anew, then the heaviest and the
        lightest shard exchange a slot or two, again and again, each time by what brings them closest,
        until they differ by `tolerance` of the mean or no exchange helps."""
        n = n_shards or self.n_shards
        held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for slot, shard in enumerate(self.shard):
            held[shard if shard < n else slot % n].append((weight[slot], slot))
        for x in held:
            x.sort()
        load = [sum(w for w, _ in x) for x in held]
        enough = tolerance * sum(load) / n
        for _ in range(20 * len(self.shard)):
            high, low = max(range(n), key=load.__getitem__), min(range(n), key=load.__getitem__)
            gap = load[high] - load[low]
            if gap <= enough:
                break
            best = None
            others = [(0, -1), *held[low]]
            for a in held[high]:
                want = (a[0] - gap / 2, -1)
                i = bisect_left(others, want)
                for b in others[max(0, i - 1) : i + 1]:
                    moved = a[0] - b[0]
                    if 0 < moved < gap and (best is None or abs(moved - gap / 2) < best[0]):
                        best = (abs(moved - gap / 2), a, b)
            if best is None:
                break
            _, a, b = best
            held[high].remove(a)
            held[low].append(a)
            if b[1] >= 0:
                held[low].remove(b)
                held[high].append(b)
                held[high].sort()
            held[low].sort()
            load[high] += b[0] - a[0]
            load[low] += a[0] - b[0]
        shard = [0] * len(self.shard)
        for s, x in enumerate(held):
            for _, slot in x:
                shard[slot] = s
        return SlotMap(self.version + 1, n, tuple(shard))


def records(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size (text bytes plus OVERHEAD), text_crc32 and virtual_slot of each row.

    The slot hashes the id and the text's checksum, so rows without an id are spread by their texts.
    Rows equal in both that are more than REPEATS are dealt over all slots one by one, each by where
    it stands; a slot would else hold them all. That number isn't the same in a second evaluation, so
    the result must be written before it is used twice.
    """
    rows = docs.select(F.col(id_col).alias("id"), (text_bytes(text_col) + OVERHEAD).alias("size"), text_crc(text_col).alias("text_crc32"))
    # texts are read once; what is grouped and joined from here on is a few numbers a row
    rows = written(rows.withColumn("key", F.xxhash64("id", "text_crc32")), "sized")
    many = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REPEATS).select("key", F.lit(True).alias("many")), "repeats")
    on = ["key"]
    if many.count() <= MOST_BROADCAST:
        many = F.broadcast(many)
    else:
        on = ["key", "salt"]
        many = many.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.withColumn("salt", F.monotonically_increasing_id() % SALTS)
    slot = F.when(F.col("many"), slot_of(n_slots, F.col("key"), F.monotonically_increasing_id())).otherwise(slot_of(n_slots, F.col("id"), F.col("text_crc32")))
    return rows.join(many, on, "left").select(F.col("id").alias(id_col), "size", "text_crc32", slot.alias("virtual_slot"))


def slot_weights(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; at most n_slots rows come to the driver."""
    size, count = [0] * n_slots, [0] * n_slots
    for slot, b, c in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        size[slot], count[slot] = b, c
    return size, count


def versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """Versions of the map at path, and whether each was written to its end."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    where = name(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return {}
    folders = [f.getPath().getName() for f in store.listStatus(where)]
    return {int(f.removeprefix("version=")): store.exists(name(f"{path}/{f}/_SUCCESS")) for f in folders if f.startswith("version=")}


def stored(spark: SparkSession, path: str) -> SlotMap | None:
    """The latest whole map at path; None where there is none yet."""
    return SlotMap.load(spark, path) if any(versions(spark, path).values()) else None


def added(spark: SparkSession, new: SlotMap, path: str) -> SlotMap:
    """new, saved under the first number above all versions there, those of writes that failed among them."""
    new = replace(new, version=max(versions(spark, path), default=-1) + 1)
    new.save(spark, path)
    return new


def shard(docs: DataFrame, n_shards: int, path: str | None = None, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put each row of docs into a shard of near equal bytes (law `bytes`).

    Returns id_col, size, text_crc32, law, shard, slot (the row's place in its shard, gapless from 0),
    grown_shard (null under this law), virtual_slot and map_version. With `path`, the map stored there
    is edited: slots move as little as balance asks, and the next version is stored if any moved;
    where none is stored, the first map and its rebalanced version are. So the shards hang on what earlier
    runs stored there; a version that a failed run left behind is passed over, and of two runs at once that
    edit the map one fails. A map of another number of slots there is an error. Null texts weigh OVERHEAD; null ids and repeated rows are rows like
    others; very long texts are read for their length and checksum only; of an empty table nothing
    is returned; columns not named are not read. A row can't be split, so shards are near equal as
    far as single rows are small beside a shard.
    """
    spark = docs.sparkSession
    rows = written(records(docs, n_slots, id_col, text_col), "records")
    size, count = slot_weights(rows, n_slots)
    old = stored(spark, path) if path else None
    if old is None:
        old = SlotMap.first(n_slots, n_shards)
        if path:
            old = added(spark, old, path)
    if len(old.shard) != n_slots:
        raise ValueError(f"the map at {path} has {len(old.shard)} slots, not {n_slots}")
    new = old.rebalance(size, n_shards)
    if new.shard == old.shard and new.n_shards == old.n_shards:
        new = old
    elif path:
        new = added(spark, new, path)
    base, filled = [0] * n_slots, [0] * n_shards
    for slot, s in enumerate(new.shard):
        base[slot] = filled[s]
        filled[s] += count[slot]
    slot = F.col("virtual_slot")
    order = Window.partitionBy("virtual_slot").orderBy(F.col(id_col).asc_nulls_last(), "text_crc32", "size")
    return rows.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        new.of(slot).alias("shard"),
        (_looked_up(base, slot, "long") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(new.version).alias("map_version"),
    )
