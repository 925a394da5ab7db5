"""Queries over tables that have what larger copies of the standard tables have, against their SQL."""

import os
import random

import pytest
from conftest import rows

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TESTDATA = "/root/testdata/sf0.001"


def oracle(name, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET threads = 1; SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=repr)


def with_tables(folder, **made):
    """A folder with the standard tables, some of them put in place of the given."""
    for t in TABLES:
        if t in made:
            made[t].coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        else:
            os.symlink(f"{TESTDATA}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def test_points_whose_numbers_meet_are_one(spark, tmp_path):
    part = spark.read.parquet(f"{TESTDATA}/part.parquet").limit(1)
    made = lambda *keys: part.unionByName(part).limit(1).selectExpr("explode(array(" + ", ".join(map(str, keys)) + ")) AS k", "*").selectExpr("CAST(k AS BIGINT) AS p_partkey", "concat('n', k) AS p_name", *[c for c in part.columns if c not in ("p_partkey", "p_name")])
    item = spark.read.parquet(f"{TESTDATA}/lineitem.parquet")
    one = lambda order, part_, line: item.limit(1).selectExpr(f"CAST({order} AS BIGINT) AS l_orderkey", f"CAST({part_} AS BIGINT) AS l_partkey", "l_suppkey", f"CAST({line} AS {dict(item.dtypes)['l_linenumber']}) AS l_linenumber", *item.columns[4:])
    items = one(1, 5, 2).unionByName(one(0, 100_005, 2)).unionByName(one(3, 100_005, 1)).unionByName(one(4, 5, 1)).unionByName(one(3, 100_005, 1))
    d = with_tables(tmp_path, part=made(5, 100_005), lineitem=items)
    got = rows(entry.queries()["enclosing_interval"](spark, d), "point", "node_id")
    # any_value leaves open which row counts: here the table's first
    assert got == [(100_005_002, "P:5"), (400_005_001, "P:100005")] and [p for p, _ in got] == [p for p, _ in oracle("enclosing_interval", d)]


def test_similar_pairs_are_not_formed(spark, monkeypatch):
    """The same rows as from all pairs, with many functions of one file, size and group; the query forms no pairs."""
    from tracewright import schema as S
    from tracewright.operators import links
    from tracewright.plans import graph_view as g
    from tracewright.plans import queries as Q

    rng = random.Random(5)
    monkeypatch.setattr(S, "SIMILAR_MAX", 4)
    files = [f"f{i}.ts" for i in range(6)] + ["x.test.ts"]
    made = [(f"n{i}", f"m{rng.randrange(3)}", rng.choice(files) if i % 3 else "f1.ts", 1, 9, "Function" if i % 7 else "Type", False, None, None, i) for i in range(240)]
    n = spark.createDataFrame(made, S.NODES + ", ord long")
    size = {r[0]: (rng.choice([None, "a", "a", "b"]), rng.choice([1, 2, 3, 9, 20, 26])) for r in made}
    sized = spark.createDataFrame([(i, *v) for i, v in size.items()], "id string, group string, size long")
    pairs = [(a, b, 1 - abs(size[a][1] - size[b][1]) / 50) for a in size for b in size if a < b and size[a][0] and size[a][0] == size[b][0]]
    want = links.similar(n, spark.createDataFrame(pairs, "a string, b string, score double"))
    assert rows(links.similar_by_size(n, sized, g.size_score, g.SIZES_APART)) == rows(want) != []
    monkeypatch.setattr(g, "similar_pairs", lambda *_: pytest.fail("all pairs"))
    Q.QUERIES["similar_pairs_top20"](spark, TESTDATA)
