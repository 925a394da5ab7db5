"""Prefix trie of rebuilt conversations: composable fingerprints of turns, never a rebuilt text.

A conversation c is rebuilt from a head (the first h turns of its base conversation) and its own turns
after its first h. The fingerprint of a sequence of turns is an element (length, hash) of a monoid,
(m, x) * (n, y) = (m + n, x + r ** m * y) in four lanes modulo a prime, so the fingerprint of each
rebuilt prefix is the base's head times a quotient of two of c's own prefixes, and no text moves.

A prefix group (depth, fingerprint) is one node. Equality is verified, not assumed: turns are stored
once and named by hashes, a name is good if the smallest and the largest text under it are equal, and
a group is good if all its members refer to one parent fingerprint and one name of their last turn;
by induction over depths they are then equal sequences. If any check fails, everything is named anew
with another seed.

Sums over subtrees need no walk by levels: each node belongs to its smallest member, a member's nodes
are summed from its end upwards, and a node's subtree is the sum of its members' sums at its depth.
"""

from __future__ import annotations

import hashlib
import random
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written
from .running import PRIME, running

HEADS = 6  # h is below this
CENTURY = 100
LANES = 4
HALF = 31  # bits of a lane
SHORT = 64  # characters of role and text that deal rows to tasks
CHUNK = 1 << 16

NODE = ["depth", "a", "b"]


def _stored(turns: DataFrame, seed: int, bits: int) -> DataFrame:
    """conv_id, turn, role, text without nulls, and the two halves of each turn's name."""
    t = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    mask = F.lit((1 << bits) - 1)
    name = lambda k: F.xxhash64(F.lit(2 * seed + k), F.length("role"), "role", "text").bitwiseAND(mask)
    return t.select("*", name(0).alias("x"), name(1).alias("y"))


def _names_agree(stored: DataFrame) -> bool:
    """Whether no two different turns have one name."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("role", "text") for f in (F.min, F.max)]
    return stored.groupBy("x", "y").agg(*ends).filter("min_role <> max_role OR min_text <> max_text").isEmpty()


def _h(conv_id: str) -> Column:
    return F.crc32(F.col(conv_id).cast("string")) % HEADS


def _packed(lanes: list[Column]) -> list[Column]:
    """Two longs that hold the four lanes."""
    return [F.shiftleft(lanes[0], HALF) + lanes[1], F.shiftleft(lanes[2], HALF) + lanes[3]]


def _prefixes(own: DataFrame, bases: list[int], prime: int) -> DataFrame:
    """conv_id, depth, fingerprint (a, b), the parent's (pa, pb), name of the last turn (x, y), its code points, ending: a row for each rebuilt prefix."""
    at, up_to, before = F.col("place"), [f"sum{k}" for k in range(LANES)], [f"before{k}" for k in range(LANES)]
    own = own.select("*", _h("conv_id").alias("h"))
    whole = own.groupBy("conv_id").agg(F.first("h").alias("h"), F.count("*").alias("n"), *[F.coalesce(F.max(F.when(at == F.col("h"), F.col(c))), F.lit(0)).alias(f"own{k}") for k, c in enumerate(up_to)])
    heads = own.filter((F.col("conv_id") % CENTURY == 0) & (at < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "x", "y", "chars", *up_to, *before))).alias("head"))
    convs = whole.select("*", (F.col("conv_id") - F.col("conv_id") % CENTURY).alias("base")).join(heads, "base", "left")
    convs = convs.select("conv_id", "h", "n", *[f"own{k}" for k in range(LANES)], F.expr("CASE WHEN head IS NULL THEN array() ELSE slice(head, 1, CAST(h AS INT)) END").alias("head")).withColumn("k", F.size("head"))
    convs = written(
        convs.select("*", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), *[F.coalesce(F.try_element_at("head", F.lit(-1))[c], F.lit(0)).alias(f"base{k}") for k, c in enumerate(up_to)]),
        "conversations",
    )
    nothing = F.lit(0).cast("long")
    root = convs.select("conv_id", nothing.alias("depth"), *[nothing.alias(c) for c in ("a", "b", "pa", "pb", "x", "y", "chars")], (F.col("length") == 0).alias("ending"))
    in_head = convs.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", "length", "t.*")
    in_head = in_head.select("conv_id", at.alias("depth"), *[c.alias(n) for c, n in zip(_packed([F.col(c) for c in up_to]) + _packed([F.col(c) for c in before]), ("a", "b", "pa", "pb"), strict=True)], "x", "y", "chars", (at == F.col("length")).alias("ending"))
    # own prefix over own head, moved down from place h to place k, after the base's head
    tail = own.filter(at > F.col("h")).drop("h").join(convs.drop("head", "n"), "conv_id")
    moved = {}
    for side, columns in (("", up_to), ("p", before)):
        lanes = []
        for k, c in enumerate(columns):
            back = F.array(*[F.lit(pow(bases[k], -m, prime)) for m in range(HEADS)])[(F.col("h") - F.col("k")).cast("int")]
            lanes.append(F.pmod(F.col(f"base{k}") + F.pmod(F.col(c) - F.col(f"own{k}"), F.lit(prime)) * back, F.lit(prime)))
        moved[f"{side}a"], moved[f"{side}b"] = _packed(lanes)
    depth = at - F.col("h") + F.col("k")
    tail = tail.select("conv_id", depth.alias("depth"), *[moved[c].alias(c) for c in ("a", "b", "pa", "pb")], "x", "y", "chars", (depth == F.col("length")).alias("ending"))
    return root.unionByName(in_head).unionByName(tail)


def _digest(batches):
    """Groups of the sorted ids: a digest for each that lies whole and short within the task, else its text in chunks."""
    import numpy as np
    import pyarrow as pa

    node, text, size, first, chunked, seen = None, [], 0, 0, False, 0
    out: list[tuple] = []

    def flush(done: bool, edge: bool):
        nonlocal text, size, chunked
        whole = ",".join(text)
        if done and not chunked and not edge:
            out.append((*node, first, None, hashlib.sha256(whole.encode()).hexdigest()))
        elif text:
            out.append((*node, first, whole, None))
            chunked = True
        text, size = [], 0

    def batch_of():
        nonlocal out
        columns = list(zip(*out, strict=True))
        out = []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NODE, "first_id", "chunk", "digest"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = [batch.column(i).to_numpy() for i in range(3)]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        ids = [str(x) for x in batch.column(3).to_pylist()]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            now = tuple(int(k[lo]) for k in keys)
            if now != node:
                if node is not None:
                    flush(True, seen == 1)
                node, chunked, seen = now, False, seen + 1
            for i in range(lo, hi):
                if not text:
                    first = int(ids[i])
                text.append(ids[i])
                size += len(ids[i]) + 1
                if size > CHUNK:
                    flush(False, True)
        if out:
            yield batch_of()
    if node is not None:
        flush(True, True)
    if out:
        yield batch_of()


def _digest_chunks(batches):
    """Digest of each group's chunks, which come sorted, with a hash state as the only memory."""
    import pyarrow as pa

    node, state, done = None, None, []
    for batch in batches:
        for *now, chunk in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if now != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = now, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
    if node is not None:
        done.append((*node, state.hexdigest()))
    for lo in range(0, len(done), 10_000):
        part = done[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in part], pa.int64()) for i in range(3)], pa.array([r[3] for r in part])], [*NODE, "ends_sha256"])


def ends(prefixes: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of each node at which conversations end.

    Ids are dealt by ranges of (node, id), so a node's many ends are turned to text by many tasks; a
    SHA-256 is one chain, which then reads chunks of 64 KB with a constant state.
    """
    last = prefixes.filter("ending").select(*NODE, "conv_id")
    parts = written(last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(tidy(_digest), "depth long, a long, b long, first_id long, chunk string, digest string"), "ends")
    chunks = parts.filter("chunk IS NOT NULL").select(*NODE, "first_id", "chunk").repartition(*NODE).sortWithinPartitions(*NODE, "first_id").select(*NODE, "chunk")
    whole = parts.filter("digest IS NOT NULL").select(*NODE, F.col("digest").alias("ends_sha256"))
    return whole.unionByName(chunks.mapInArrow(tidy(_digest_chunks), "depth long, a long, b long, ends_sha256 string"))


def _nodes(turns: DataFrame, seed: int, bits: int, prime: int) -> tuple[DataFrame, DataFrame] | None:
    """Rebuilt prefixes and nodes, or None if two different turns or sequences have one fingerprint."""
    stored = _stored(turns, seed, bits)
    if not _names_agree(stored):
        return None
    bases = [random.Random(f"{seed}/{k}").randrange(2, prime) for k in range(LANES)]
    low = F.lit((1 << HALF) - 1)
    lanes = [x for c in ("x", "y") for x in (F.shiftright(c, HALF).bitwiseAND(low), F.col(c).bitwiseAND(low))]
    slim = stored.select("conv_id", "turn", "role", "text", "x", "y", F.length("text").cast("long").alias("chars"), *[c.alias(f"lane{k}") for k, c in enumerate(lanes)])
    turn, role, text = F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")
    short = [turn, F.left(role, F.lit(SHORT)), F.when(F.length(role) < SHORT, F.left(text, F.lit(SHORT))).otherwise("")]
    names = [f"lane{k}" for k in range(LANES)]
    own = running(slim, "conv_id", short, [turn, role, text], names, drop=("turn", "role", "text"), bases=bases, prime=prime).drop(*names)
    prefixes = written(_prefixes(own, bases, prime), "prefixes")
    refs = [f(c).alias(f"{f.__name__}_{c}") for c in ("pa", "pb", "x", "y") for f in (F.min, F.max)]
    nodes = written(prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *refs), "nodes")
    if not nodes.filter(" OR ".join(f"min_{c} <> max_{c}" for c in ("pa", "pb", "x", "y"))).isEmpty():
        return None
    return prefixes, nodes.select(*NODE, F.col("min_pa").alias("pa"), F.col("min_pb").alias("pb"), "conv_id", "n_convs", "chars")


def trie(turns: DataFrame, bits: int = 2 * HALF, prime: int = PRIME) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations; the last turn of a node is a stored one.

    turns: conv_id, turn, role, text; other columns are ignored. Rows without a conv_id are left out;
    a null role or text counts as empty; turns go by turn (null first), then role, then text, and
    repeated rows are turns of their own. A conversation all of whose turns are cut and whose base is
    absent ends at the root. No rows give no nodes; texts of any length are read whole. conv_id % 100
    has the sign of conv_id. bits, prime: of the first try (tests make them small); later tries take
    the full ones.
    """
    for seed in count():
        found = _nodes(turns, seed, *((bits, prime) if seed == 0 else (2 * HALF, PRIME)))
        if found:
            break
    prefixes, nodes = found
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    facts = nodes.join(children, NODE, "left").select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.col("n_children").isNull().cast("long").alias("leaf"))
    owned = prefixes.select("conv_id", *NODE).join(facts, ["conv_id", "depth"], "left").select("conv_id", *NODE, F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    upwards = [F.col("depth").desc()]
    sums = running(owned, "conv_id", upwards, upwards, ["saved", "leaf"]).groupBy(*NODE).agg(F.sum("sum0").alias("saved_tokens"), F.sum("sum1").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, NODE).join(children, NODE, "left").join(ends(prefixes), NODE, "left").join(parents, ["depth", "pa", "pb"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
