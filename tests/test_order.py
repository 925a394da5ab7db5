"""Places of a whole table, and neighbourhood counts with pairs and with bitmaps."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewright.operators import neighbourhood, order


def test_places_are_those_of_one_sort(spark):
    r = random.Random(2)
    data = [(i, r.choice([None, 1.5, 2.5, float("nan"), -1.0]), i % 7) for i in range(800)]
    df = spark.createDataFrame(data, "id long, v double, w long").repartition(7)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = order.places(df, [F.col("v").desc_nulls_last(), F.col("id").asc()])
        assert "SinglePartition" not in got._jdf.queryExecution().toString()
        found = got.orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [r.id for r in df.orderBy(F.col("v").desc_nulls_last(), "id").collect()]
    assert [r.id for r in found] == want and [r.place for r in found] == list(range(1, 801)) and got.columns == ["id", "v", "w", "place"]
    assert rows(order.places(df.limit(0), [F.col("id")])) == []
    assert sorted(r.place for r in order.places(df.select(F.lit(1).alias("x")), [F.col("x")]).collect()) == list(range(1, 801))


def plain(ids, pairs, hops):
    good = {(a, b) for a, b in pairs if a != b and a in ids and b in ids}
    out = {}
    for i in ids:
        found = set()
        for way in (good, {(b, a) for a, b in good}):
            tip = {i}
            for _ in range(hops):
                tip = {b for a, b in way if a in tip}
                found |= tip
        out[i] = len(found - {i})
    return out


@pytest.mark.parametrize("hops", [1, 2, 3])
@pytest.mark.parametrize("most", [1000, 3, 0])
def test_neighbourhoods(spark, hops, most):
    r = random.Random(hops)
    ids = [f"n{i}" for i in range(25)]
    pairs = [(r.choice(ids), r.choice([*ids, "gone"])) for _ in range(45)] + [("n0", i) for i in ids] + [(i, "n1") for i in ids[:12]]
    n, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string")
    assert dict(rows(neighbourhood.counts(n, e, hops, most))) == plain(set(ids), pairs, hops)


@pytest.mark.parametrize("most", [2, 1024])
def test_two_steps_form_no_pairs(spark, monkeypatch, most):
    """A row for each step, not for each node behind it; with hubs and without."""
    monkeypatch.setattr(neighbourhood, "_walked", lambda *_: pytest.fail("pairs"))
    ids = [f"n{i}" for i in range(9)]
    pairs = [("n0", f"n{i}") for i in range(1, 6)] + [(f"n{i}", "n6") for i in range(1, 6)] + [("n6", "n7"), ("n7", "n0"), ("n7", "n0"), ("n6", "gone")]
    n, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string")
    known = [p for p in pairs if p[1] != "gone"]
    assert dict(rows(neighbourhood.counts(n, e, 2, most))) == plain(set(ids), known, 2)
