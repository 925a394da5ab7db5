"""The record store against a dictionary: merging in any grouping, replays, cut writes, bytes by batch."""

import os
import random

from conftest import rows

from tracewright.streaming.store import RecordStore

FIELDS = "id string, text string, stale boolean, n long"
UPDATES = f"{FIELDS}, cleared array<string>, seq long"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def some_batches(seed, n=9, keys=12):
    r = random.Random(seed)
    maybe = lambda x: x if r.random() < 0.5 else None
    return [[(r.choice([f"k{r.randrange(keys)}"] * 9 + [None]), maybe(f"t{r.random()}"), maybe(r.random() < 0.5), maybe(r.randrange(99)), r.choice([None, [], ["text"], ["n", "stale"]]), i * 100 + b) for i in range(r.randrange(8))] for b in range(n)]


def plain(batches):
    out = {}
    for batch in batches:
        for key, *values, cleared, _ in sorted(batch, key=lambda u: u[-1]):
            if key is None:
                continue
            old = out.setdefault(key, [None] * 3)
            for i, (name, v) in enumerate(zip(("text", "stale", "n"), values, strict=True)):
                if name in (cleared or []):
                    old[i] = None
                elif v is not None:
                    old[i] = v
    return sorted(((k, *v) for k, v in out.items()), key=repr)


def test_store_equals_a_dictionary(spark, tmp_path):
    batches = some_batches(4)
    store = RecordStore(spark, str(tmp_path / "s"), "id", FIELDS, fan=3, buckets=4)
    assert rows(store.read()) == []
    for number, batch in enumerate(batches):
        assert store.append(spark.createDataFrame(batch, UPDATES), number)
        if number in (3, 6):
            store.compact()
            assert rows(store.read()) == plain(batches[: number + 1])
        if number == 6:
            before = rows(store.read())
            assert not store.append(spark.createDataFrame(batch, UPDATES), 5)  # within a merged run
            assert store.vacuum() > 0 and rows(store.read()) == before
    assert rows(store.read()) == plain(batches)
    store.compact()
    assert [r[0] for r in store.runs()] == [2]
    assert rows(store.read()) == plain(batches)
    assert rows(store.lookup(["k1", "k7", "gone"])) == [r for r in plain(batches) if r[0] in ("k1", "k7")]


def test_a_cut_write_does_not_count(spark, tmp_path):
    path = str(tmp_path / "s")
    store = RecordStore(spark, path, "id", FIELDS, fan=2)
    up = lambda *r: spark.createDataFrame([r], UPDATES)
    store.append(up("a", "x", None, 1, None, 1), 0)
    store.append(up("a", "y", None, None, None, 1), 1)
    store.compact()
    os.remove(f"{path}/L1-0-1/_SUCCESS")  # the merge was cut: its parts still count
    assert rows(store.read()) == [("a", "y", None, 1)]
    os.remove(f"{path}/L0-1-1/_SUCCESS")  # the batch was cut: it comes again
    assert rows(store.read()) == [("a", "x", None, 1)]
    assert store.append(up("a", "y", None, None, None, 1), 1) and rows(store.read()) == [("a", "y", None, 1)]


def test_a_batch_writes_by_its_own_size(spark, tmp_path):
    path = str(tmp_path / "s")
    store = RecordStore(spark, path, "id", FIELDS)
    many = spark.range(200_000).selectExpr("'k' || id AS id", "repeat(md5(CAST(id AS STRING)), 2) AS text", "true AS stale", "id AS n", "CAST(null AS array<string>) AS cleared", "1L AS seq")
    store.append(many, 0)
    first = size(path)
    store.append(spark.createDataFrame([("k7", "new", None, None, None, 1)], UPDATES), 1)
    assert size(path) - first < first / 500
    assert store.read().count() == 200_000 and rows(store.lookup(["k7"])) == [("k7", "new", True, 7)]


def test_sink_comes_again_without_change(spark, tmp_path):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    store = RecordStore(spark, str(tmp_path / "s"), "id", FIELDS, fan=2)
    os.makedirs(src)
    batches = [[(f"k{i}", f"t{b}", None, b, None, 1) for i in range(b, b + 3)] for b in range(4)]
    for b in batches:
        spark.createDataFrame(b, UPDATES).coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).json(src)
        store.sink(stream, cp, once=True, background=False).awaitTermination()
    assert rows(store.read()) == plain(batches)
    # the whole stream again under another checkpoint: the same batch numbers, nothing new
    store.sink(spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).json(src), cp + "2", once=True, background=False).awaitTermination()
    assert rows(store.read()) == plain(batches)
