"""Places and running sums of the rows of each key, for keys of any size.

Rows are dealt by ranges of (key, order), so a key with many rows lies over several tasks. Each task
numbers and sums its own pieces; a piece is an element (rows, sums) of a monoid, and the pieces before
it are composed from one first and one last row of each partition, which is all the driver sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

#: Sums with bases are taken modulo this prime, so that products of two of them fit a long.
PRIME = (1 << 31) - 1


def powers(base: int, exponents, prime: int):
    """base ** exponents modulo prime, for an array of exponents."""
    import numpy as np

    out, square, left = np.ones(len(exponents), np.int64), base % prime, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        left, square = left >> 1, square * square % prime
    return out


def _pieces(key_at: int, value_at: list[int], bases: list[int] | None, prime: int):
    """A function of sorted Arrow batches: adds part, place, sums up to each row and before it, and edge (1: first row of the part, 2: last, 3: both)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, place, sums, waiting = None, 0, [0] * len(value_at), None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            key = batch.column(key_at).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last is None or key[0] != last
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: goes on from the batch before
            places = np.arange(n) - start + 1
            places[start < 0] += place - 1
            out = []
            for k, i in enumerate(value_at):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                if bases:
                    x = x % prime * powers(bases[k], places - 1, prime) % prime
                total = np.cumsum(x)
                up_to = total - np.where(start > 0, total[start - 1], 0)
                up_to[start < 0] += sums[k]
                before = up_to - x
                out += [up_to % prime, before % prime] if bases else [up_to, before]
                sums[k] = int(out[-2][-1])
            last, place = key[-1], int(places[-1])
            edge = np.zeros(n, np.int8)
            if waiting is None:
                edge[0] = 1
            else:
                yield pa.RecordBatch.from_arrays(*_named(waiting))
            waiting = (batch, part, places, out, edge)
        if waiting is not None:
            waiting[4][-1] |= 2
            yield pa.RecordBatch.from_arrays(*_named(waiting))

    def _named(held):
        import numpy as np
        import pyarrow as pa

        batch, part, places, out, edge = held
        columns = [*batch.columns, pa.array(np.full(len(edge), part, np.int32)), pa.array(places), *map(pa.array, out), pa.array(edge)]
        names = [*batch.schema.names, "part", "place", *[f"{side}{k}" for k in range(len(value_at)) for side in ("sum", "before")], "edge"]
        return columns, names

    return tidy(run)


def running(df: DataFrame, key: str, by: Sequence[Column], order: Sequence[Column], values: Sequence[str], drop: Sequence[str] = (), bases: Sequence[int] | None = None, prime: int = PRIME) -> DataFrame:
    """The columns of df but those of drop, with place (from 1 within the key), and for value k sum<k> (up to the row) and before<k> (without it).

    key: a long without nulls. by: expressions that deal the rows, in step with order (a prefix of it, or
    short prefixes of its texts), for rows of one key. With bases, value v in place i counts as
    v * base ** (i - 1) modulo prime, so the sum of a run of rows that follows n others is base ** n
    times the sum that it has alone. Stored in the shared folder.
    """
    spark, values = df.sparkSession, list(values)
    kept = [c for c in df.columns if c not in drop]
    dealt = df.repartitionByRange(F.col(key), *by).sortWithinPartitions(F.col(key), *order).select(*kept)
    sums = "".join(f", sum{k} long, before{k} long" for k in range(len(values)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    bases = list(bases) if bases else None
    rows = written(dealt.mapInArrow(_pieces(kept.index(key), [kept.index(v) for v in values], bases, prime), f"{fields}, part int, place long{sums}, edge byte"), "pieces")
    offsets, ended = [], {}
    for r in rows.filter("edge > 0").orderBy("part", "place").collect():  # at most two of each partition
        k = r[key]
        if r["edge"] & 1 and k in ended:
            offsets.append((r["part"], k, *ended[k]))
        if r["edge"] & 2:
            n, *before = ended.get(k, (0, *[0] * len(values)))
            ended = {k: (n + r["place"], *[(b + pow(bases[i], n, prime) * r[f"sum{i}"]) % prime if bases else b + r[f"sum{i}"] for i, b in enumerate(before)])}
    shifts = spark.createDataFrame(
        [(p, k, n, *b, *[pow(x, n, prime) for x in bases or []]) for p, k, n, *b in offsets],
        "part int, at_key long, rows_before long" + "".join(f", from{k} long" for k in range(len(values))) + "".join(f", by{k} long" for k in range(len(bases or []))),
    )
    out = rows.join(F.broadcast(shifts), (rows["part"] == shifts["part"]) & (rows[key] == shifts["at_key"]), "left")
    done = [rows[c] for c in kept] + [(rows["place"] + F.coalesce("rows_before", F.lit(0))).alias("place")]
    for k in range(len(values)):
        for side in ("sum", "before"):
            start = F.coalesce(f"from{k}", F.lit(0))
            own = rows[f"{side}{k}"]
            done.append((F.pmod(start + own * F.coalesce(f"by{k}", F.lit(1)), F.lit(prime)) if bases else start + own).alias(f"{side}{k}"))
    return out.select(*done)
