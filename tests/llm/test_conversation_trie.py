"""The prefix trie against a plain one built from whole rebuilt texts; running sums over split keys."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewright.llm import conversation_trie
from tracewright.llm.running import PRIME, running

SCHEMA = "conv_id long, turn long, role string, text string, n_convs long, a string"


def plain(turns):
    own = defaultdict(list)
    for c, turn, role, text, *_ in sorted(((c, t, r or "", x or "") for c, t, r, x, *_ in turns if c is not None), key=lambda r: (r[0], (r[1] is not None, r[1] or 0), r[2].encode(), r[3].encode())):
        own[c].append((role, text))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(cs) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, cs in members.items():
        done = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_turns(seed, n=150):
    r = random.Random(seed)
    texts = ["hello", "", None, "x" * 70 + "a", "x" * 70 + "b", "é𝄞", "bye"]
    roles = ["user", "assistant", None, ""]
    out = []
    for c in [*range(n), 200, 205, 207, 1003, -5, -107, -100, 10**12 + 7]:
        if c % 100 == 0 and r.random() < 0.3:
            continue
        for t in range(r.choice([1, 2, 3, 5, 8, 9])):
            out.append((c, r.choice([None, t, t, t]), r.choice(roles[: 1 + seed % 4]), r.choice(texts[: 2 + seed]), 7, "z"))
    out += out[:5] + [(None, 0, "user", "lost", 7, "z"), (3, None, None, None, 7, "z")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_plain(spark, seed):
    turns = some_turns(seed)
    tight = {0: {}, 1: {"bits": 1}, 2: {"prime": 2**3 - 1}}[seed]  # first tries that must fail
    assert rows(conversation_trie.trie(spark.createDataFrame(turns, SCHEMA).repartition(3), **tight)) == plain(turns)


def test_collisions_are_found(spark):
    turns = spark.createDataFrame(some_turns(2), SCHEMA)
    assert conversation_trie._nodes(turns, 0, 1, PRIME) is None  # names of turns
    assert conversation_trie._nodes(turns, 0, 62, 3) is None  # products
    assert conversation_trie._nodes(turns, 0, 62, PRIME) is not None


def test_hot_first_turn_many_ends_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 50)  # ends of the common node come in chunks
    turns = [(c, 0, "user", "same", 0, "") for c in range(0, 60_000, 100)]
    turns += [(c, t, "user", f"t{t % 9}", 0, "") for c in (100, 250) for t in range(1, 3000)]
    got = rows(conversation_trie.trie(spark.createDataFrame(turns, SCHEMA).repartition(7)))
    short = [t for t in turns if t[1] < 40]
    want = plain(short)
    assert len(got) > 3000 and [g for g in got if g[1] < 2 and g[3] > 2] == [w[:6] + (g[6],) + w[7:] for g, w in zip([g for g in got if g[1] < 2 and g[3] > 2], [w for w in want if w[1] < 2 and w[3] > 2], strict=True)]
    assert max(g[1] for g in got) >= 2999 - 5


def test_no_rows(spark):
    assert rows(conversation_trie.trie(spark.createDataFrame([], SCHEMA))) == []
    assert rows(conversation_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "")], SCHEMA))) == []


@pytest.mark.parametrize("bases", [None, [3, 10**9]])
def test_running_sums_of_split_keys(spark, bases):
    r = random.Random(5)
    data = [(k, i, r.randrange(1 << 30), r.randrange(50)) for k, n in ((1, 3), (2, 900), (3, 1), (4, 200)) for i in range(n)]
    df = spark.createDataFrame(data, "key long, i long, u long, v long").repartition(5)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = running(df, "key", [F.col("i")], [F.col("i")], ["u", "v"], bases=bases).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, sums = {}, defaultdict(lambda: [0, 0])
    for k, i, u, v in data:
        before = list(sums[k])
        for n, x in enumerate((u, v)):
            sums[k][n] = (sums[k][n] + x * pow(bases[n], i, PRIME)) % PRIME if bases else sums[k][n] + x
        want[k, i] = (i + 1, sums[k][0], before[0], sums[k][1], before[1])
    assert {(g["key"], g["i"]): tuple(g)[4:] for g in got} == want
