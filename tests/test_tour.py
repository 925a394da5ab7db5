"""Pre-order by Euler tours against plain walks."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewright.operators.tour import preorder

TREE = "root string, id string, parent string"


def plain(tree):
    """(root, id, parent, depth, size, ord) by a walk of each root's top rows."""
    out = []
    for root in {t[0] for t in tree}:
        own = {i: p for r, i, p in tree if r == root}
        below = {}
        for i, p in own.items():
            below.setdefault(p if p in own else None, []).append(i)
        found, stack = [], [(i, 0) for i in sorted(below.get(None, []), reverse=True)]
        while stack:
            i, depth = stack.pop()
            found.append((i, depth))
            stack += [(c, depth + 1) for c in sorted(below.get(i, []), reverse=True)]
        for k, (i, depth) in enumerate(found):
            size = next((j for j in range(k + 1, len(found)) if found[j][1] <= depth), len(found)) - k
            out.append((root, i, own[i] if own[i] in own else None, depth, size, k + 1))
    return sorted(out, key=repr)


def test_random_forests(spark):
    r = random.Random(5)
    tree = []
    for root in "abc":
        ids = [f"{k:03d}" for k in range(r.randint(1, 90))]
        r.shuffle(ids)
        tree += [(root, i, r.choice([*ids[:k], None, "gone"]) if k else None) for k, i in enumerate(ids)]
    assert rows(preorder(spark.createDataFrame(tree, TREE))) == plain(tree)


def test_no_rows_one_row_and_a_cycle(spark):
    assert rows(preorder(spark.createDataFrame([], TREE))) == []
    assert rows(preorder(spark.createDataFrame([("a", "x", None)], TREE))) == [("a", "x", None, 0, 1, 1)]
    with pytest.raises(ValueError, match="ancestor"):
        preorder(spark.createDataFrame([("a", "x", "y"), ("a", "y", "x"), ("a", "z", None)], TREE))


def test_a_chain_of_100_000_and_a_hub(spark):
    """Rounds go with the logarithm of the depth, and no row holds a path."""
    n = 100_000
    chain = spark.range(n).select(F.lit("r").alias("root"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = preorder(chain)
    assert got.count() == n and got.filter(f"ord != id + 1 OR depth != id OR size != {n} - id").isEmpty()
    hub = spark.range(20_000).select(F.lit("r").alias("root"), "id", F.when(F.col("id") > 0, F.lit(0)).alias("parent"))
    assert preorder(hub).filter("ord != id + 1 OR depth != if(id = 0, 0, 1) OR size != if(id = 0, 20000, 1)").isEmpty()
