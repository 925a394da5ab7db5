"""How many nodes lie within so many steps of each node, either way: TRV-06.

A node's set is kept as pairs while it is small, so that the pairs of a round are at most the edges
times MOST. A larger set, such as a hub's, is a bitmap for each bucket of node numbers, and what
borders on it takes the bitmaps instead of a row for each of its members.

Two steps, the usual number, form no pairs but for hubs: each node has an array of what leads to it and
one of what it leads to, and hands to each member of one the other, so a step costs a row, not a row for
each node behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import counted, dealt, side, written, written_rows
from .order import numbered

WIDTH = 1 << 15  # numbers of a bucket, the bits of Spark's bitmaps
MOST = 1024  # members of a set of pairs that others take over


def _bucket(n: str) -> Column:
    return F.expr(f"{n} DIV {WIDTH}")


def _bits_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("c", _bucket("n").alias("bucket")).agg(F.bitmap_construct_agg(F.col("n") % WIDTH).alias("bits"))


def _merged(*parts: DataFrame | None) -> DataFrame | None:
    there = [p for p in parts if p is not None]
    if not there:
        return None
    out = there[0]
    for p in there[1:]:
        out = out.unionByName(p)
    return out.groupBy("c", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _walked(steps: DataFrame, hops: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (c, n) and bitmaps (c, bucket, bits) of what lies within so many steps; a node may have both. Pairs may recur."""
    first = steps.select("c", F.col("to").alias("n"))
    pairs, bits = first, None
    for hop in range(2, hops + 1):
        sizes = pairs.groupBy("c").agg(F.count("*").alias("size"))
        large = written_rows(sizes.filter(F.col("size") > most).select("c"), "large")
        taken, dense = pairs, bits
        if bits is not None or not large.isEmpty():
            # a set that has bitmaps is handed on as bitmaps only
            whole = large if bits is None else written_rows(large.unionByName(bits.select("c")).distinct(), "large")
            dense = _merged(_bits_of(pairs.join(whole, "c", "left_semi")), bits)
            dense = written_rows(dense, "dense")
            taken = pairs.join(whole, "c", "left_anti")
        came = steps.join(taken.withColumnRenamed("c", "to"), "to").select("c", "n")
        pairs = first.unionByName(came)
        if hop < hops:
            pairs = written_rows(pairs.distinct(), "pairs")
        bits = None if dense is None else written_rows(_merged(steps.join(dense.withColumnRenamed("c", "to"), "to").select("c", "bucket", "bits")), "bits")
    return pairs, bits


def _own_bit() -> Column:
    """1 in the row that holds a set's own number, if that is in the set: where a cycle leads back to it."""
    byte = F.conv(F.hex(F.substring("bits", (F.expr(f"c % {WIDTH} DIV 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.when((_bucket("c") == F.col("bucket")) & (byte.bitwiseAND(F.expr("shiftleft(1, CAST(c % 8 AS INT))")) != 0), 1).otherwise(0)


def _of_bits(bits: DataFrame) -> DataFrame:
    """c and n: members of each set of bitmaps but its own."""
    return bits.groupBy("c").agg(F.sum(F.bitmap_count("bits") - _own_bit()).alias("n"))


def _of_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("c != n").distinct().groupBy("c").agg(F.count("*").alias("n"))


def _within_two(steps: DataFrame, rows: int, number: str, most: int) -> DataFrame:
    """c and n: other nodes within two steps ahead or behind, of the nodes that have any. steps: c and to, each once, rows in
    number; number: type of the arrays' numbers."""
    none = F.array().cast(f"array<{number}>")

    def lists(key: str, other: str, name: str) -> DataFrame:
        """m and an array of its others; one more than most of them stand for all of a hub's."""
        place = F.row_number().over(Window.partitionBy(key).orderBy(other))
        few = dealt(steps.select(key, other), rows, key).withColumn("place", place).filter(F.col("place") <= most + 1)
        return few.groupBy(F.col(key).alias("m")).agg(F.collect_list(F.col(other).cast(number)).alias(name))

    both = lists("c", "to", "ahead").join(lists("to", "c", "behind"), "m", "full")
    sides = written(both.select("m", F.coalesce("ahead", none).alias("ahead"), F.coalesce("behind", none).alias("behind")), "sides")
    # what a node hands to those behind it, and to those ahead; a hub's many go as bitmaps
    of = lambda name: F.concat(F.array(F.col("m").cast(number)), F.when(F.size(name) <= most, F.col(name)).otherwise(none)).alias("ns")
    handed = lambda to, name: sides.filter(F.size(to) <= most).select(F.explode(to).alias("c"), of(name)).select(F.col("c").cast("long").alias("c"), "ns")
    given = handed("behind", "ahead").unionByName(handed("ahead", "behind"))
    hubs, n = counted(sides.filter((F.size("ahead") > most) | (F.size("behind") > most)).select("m", (F.size("ahead") > most).alias("wide"), (F.size("behind") > most).alias("called"), of("ahead").alias("forth"), of("behind").alias("back")), "hubs")
    # arrays travel; their pairs are told apart and counted where they arrive, so no exchange has a row for each
    exploded = lambda given: given.select("c", F.explode("ns").alias("n")).select("c", F.col("n").cast("long").alias("n"))
    light = lambda given: _of_pairs(exploded(dealt(given, 2 * rows, "c")))
    if not n:
        return light(given)
    # steps from hubs and to hubs, each with the hub as m and the other end as c
    # a hub's array can be as long as most, so few enough to be sent whole are few
    near = lambda flag, *columns: side(hubs.filter(flag).select("m", *columns), n * most)
    forth, back = steps.select("c", F.col("to").alias("m")), steps.select(F.col("to").alias("c"), F.col("c").alias("m"))
    given = given.unionByName(forth.join(near("called", "forth"), "m").select("c", F.col("forth").alias("ns"))).unionByName(back.join(near("wide", "back"), "m").select("c", F.col("back").alias("ns")))
    bits = lambda ends, others, flag: ends.join(_bits_of(others.join(near(flag), "m").select(F.col("m").alias("c"), F.col("c").alias("n"))).withColumnRenamed("c", "m"), "m").select("c", "bucket", "bits")
    bits = written_rows(_merged(bits(forth, back, "wide"), bits(back, forth, "called")), "bits")
    whole, n_whole = counted(bits.select("c").distinct(), "large")
    heavy, n_heavy = counted(hubs.select(F.col("m").alias("c")).join(side(whole, n_whole), "c", "left_anti"), "heavy")
    pairs = lambda of: exploded(given.join(of, "c", "left_semi"))
    found = _of_bits(_merged(bits, _bits_of(pairs(side(whole, n_whole))))).unionByName(_of_pairs(pairs(side(heavy, n_heavy))))
    rest = given.join(side(whole, n_whole), "c", "left_anti").join(side(heavy, n_heavy), "c", "left_anti")
    return found.unionByName(light(rest))


def counts(nodes: DataFrame, edges: DataFrame, hops: int, most: int = MOST) -> DataFrame:
    """id and n for every node: other nodes that a forward or a backward walk of at most `hops` steps reaches.

    edges: src and dst; ends that aren't nodes, repeats and self-loops don't count.
    """
    members, total = numbered(nodes.select("id"))
    members = written_rows(members.select("id", F.col("number").alias("c")), "numbers")
    key = lambda c, end: members.select(F.col("id").alias(end), F.col("c").alias(c))
    steps, rows = counted(edges.select("src", "dst").filter("src != dst").join(key("c", "src"), "src").join(key("to", "dst"), "dst").select("c", "to").distinct(), "steps")
    if hops == 2:
        found = _within_two(steps, rows, "int" if total < 1 << 31 else "long", most)
        return members.join(found, "c", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    back = steps.select(F.col("to").alias("c"), F.col("c").alias("to"))
    (ahead, ahead_bits), (behind, behind_bits) = _walked(steps, hops, most), _walked(back, hops, most)
    pairs = ahead.unionByName(behind)
    bits = _merged(ahead_bits, behind_bits)
    sparse = pairs
    if bits is not None:
        whole = written_rows(bits.select("c").distinct(), "large")
        dense = _merged(bits, _bits_of(pairs.join(whole, "c", "left_semi")))
        sparse = pairs.join(whole, "c", "left_anti")
    found = _of_pairs(sparse)
    if bits is not None:
        found = found.unionByName(_of_bits(dense))
    return members.join(found, "c", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
