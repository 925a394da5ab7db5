"""Whitening of embeddings onto the leading components, found by slicing the spectrum.

Vectors are taken as whole numbers x = floor(256 * c). Sums over the distinct vectors are exact; the
covariance is gathered from centred vectors, so only its d x d numbers and d sums reach the driver.
There an LDL^T factorisation of V - t I has as many negative pivots as V has eigenvalues below t:
halving intervals by these counts isolates each leading eigenvalue, Rayleigh quotient iteration
refines it, and counts on both sides of what it found certify its number.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

SCALE = 256
COMPONENTS = 4
LOW_BITS = 30  # sums are kept in two parts, so that no long overflows


def negative_pivots(a) -> int:
    """Number of negative eigenvalues of a symmetric matrix, by LDL^T with pivots of one or two rows."""
    import numpy as np

    a, n, k, found = np.array(a, float), len(a), 0, 0
    threshold = (1 + math.sqrt(17)) / 8
    while k < n:
        column = np.abs(a[k + 1 :, k])
        most = column.max(initial=0.0)
        if most == 0 and a[k, k] == 0:
            k += 1
            continue
        size = 1
        if abs(a[k, k]) < threshold * most:
            r = k + 1 + int(column.argmax())
            across = np.abs(a[r, k:])
            across[r - k] = 0
            wide = across.max()
            if abs(a[k, k]) * wide < threshold * most * most:
                to = k
                if abs(a[r, r]) < threshold * wide:
                    size, to = 2, k + 1
                if r != to:
                    a[[to, r], :] = a[[r, to], :]
                    a[:, [to, r]] = a[:, [r, to]]
        end = k + size
        pivot, left = a[k:end, k:end], a[end:, k:end]
        # a pivot of two rows has one eigenvalue of each sign
        found += 1 if size == 2 else int(a[k, k] < 0)
        if end < n:
            a[end:, end:] -= left @ np.linalg.solve(pivot, left.T)
        k = end
    return found


def above(v, t: float) -> int:
    """Number of eigenvalues of v above t."""
    import numpy as np

    return negative_pivots(t * np.eye(len(v)) - v)


class Component(NamedTuple):
    value: float
    vector: object
    below: float  # the number's certificate: fewer than it lie above `over`, at least as many above `below`
    over: float


def _isolated(v, k: int, low: float, high: float, tight: float) -> tuple[float, float, int]:
    """Interval that holds the k-th largest eigenvalue, and how many it holds: one, or several that lie within `tight`."""
    n_low, n_high = above(v, low), above(v, high)
    while n_low - n_high > 1 and high - low > tight:
        mid = (low + high) / 2
        n = above(v, mid)
        if n >= k:
            low, n_low = mid, n
        else:
            high, n_high = mid, n
    return low, high, n_low - n_high


def _refined(v, k: int, low: float, high: float, start, against, scale: float):
    """Eigenvalue in (low, high) and its vector, orthogonal to the vectors `against`."""
    import numpy as np

    def solved(t, x):
        for shift in (0, 1, 2, 4):
            try:
                y = np.linalg.solve(v - (t + shift * scale * 1e-16) * np.eye(len(v)), x)
            except np.linalg.LinAlgError:  # t is an eigenvalue to the last bit
                continue
            if np.isfinite(y).all() and y.any():
                break
        else:
            return x
        return clear(y / np.abs(y).max())

    def clear(y):
        for _ in range(2):
            for u in against:
                y = y - (u @ y) * u
        return y / np.linalg.norm(y)

    while True:
        x, t = clear(start), (low + high) / 2
        for _ in range(3):  # towards the eigenvalue that the interval isolates
            x = solved(t, x)
        best = (math.inf, x)
        for _ in range(12):
            t = float(x @ v @ x)
            size = float(np.linalg.norm(v @ x - t * x))
            if size < best[0]:
                best = (size, x)
            elif best[0] <= 1e-13 * scale:
                break
            x = solved(t, x)
        x = best[1]
        t = float(x @ v @ x)
        if low - scale * 1e-14 <= t <= high + scale * 1e-14 or high - low <= scale * 1e-15:
            return t, x
        mid = (low + high) / 2  # it fell into a neighbour: a narrower interval
        low, high = (mid, high) if above(v, mid) >= k else (low, mid)


def leading(v, most: int = COMPONENTS) -> list[Component]:
    """The largest eigenvalues of the symmetric matrix v, each with a unit vector and the interval that certifies its number.

    Of eigenvalues that agree to rounding, any orthogonal vectors of their space are given.
    """
    import numpy as np

    n = len(v)
    if n == 0:
        return []
    radius = np.abs(v).sum(1) - np.abs(np.diag(v))
    low, high = float((np.diag(v) - radius).min()), float((np.diag(v) + radius).max())  # Gershgorin
    scale = max(abs(low), abs(high)) or 1.0
    low, high = low - scale * 1e-9, high + scale * 1e-9
    tight = scale * 1e-14 * n
    random = np.random.default_rng(0)
    out: list[Component] = []
    for k in range(1, min(most, n) + 1):
        lo, hi, several = _isolated(v, k, low, high, tight)
        value, x = _refined(v, k, lo, hi, random.standard_normal(n), [c.vector for c in out], scale)
        if several == 1:
            lo, hi = max(lo, value - tight), min(hi, value + tight)
        if not above(v, hi) < k <= above(v, lo):
            raise ArithmeticError(f"component {k} is not certified")
        out.append(Component(value, x, lo, hi))
    return out


def _scaled(batch, width: int):
    """Rows of whole numbers, shorter vectors filled up with 0."""
    import numpy as np

    values = batch.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(batch.offsets.to_numpy())
    if len(values) == len(lengths) * width:
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _slices(batches, at: int, width: int, most: int = 1 << 22):
    """(batch, rows of whole numbers) for slices of about `most` numbers."""
    for batch in batches:
        step = max(1, most // max(1, width))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part, _scaled(part.column(at), width)


def _sums(width: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        high, low, most, n = np.zeros(width, np.int64), np.zeros(width, np.int64), 0, 0
        for _, x in _slices(batches, 0, width):
            high += (x >> LOW_BITS).sum(0)
            low += (x & ((1 << LOW_BITS) - 1)).sum(0)
            most = max(most, *(abs(int(f)) for f in (x.min(initial=0), x.max(initial=0))))
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(high), pa.array(low), pa.array([most] * width, pa.int64()), pa.array([n] * width, pa.int64())], ["i", "high", "low", "most", "n"])

    return tidy(run)


def _products(mean):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total, some = np.zeros((len(mean), len(mean))), False
        for _, x in _slices(batches, 0, len(mean)):
            d = x - mean
            total += d.T @ d
            some = True
        if some:
            i, j = np.triu_indices(len(mean))
            for lo in range(0, len(i), 1 << 16):
                hi = lo + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(i[lo:hi].astype(np.int32)), pa.array(j[lo:hi].astype(np.int32)), pa.array(total[i[lo:hi], j[lo:hi]])], ["i", "j", "v"])

    return tidy(run)


def _projected(at: int, mean, axes, sums: list[int], n: int, most: int, names: list[str]):
    """Adds the projections and the exact deviation of each row."""
    width, exact = len(mean), (n * most + max(map(abs, sums), default=0)) ** 2 * len(mean) < 1 << 63

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part, x in _slices(batches, at, width):
            if exact:
                y = n * x - np.array(sums, np.int64)
                deviation = pa.array((y * y).sum(1))
            else:
                each = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
                deviation = pa.array([v if v < 1 << 63 else None for v in each], pa.int64())
            z = (x - mean) @ axes
            columns = [c for k, c in enumerate(part.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, deviation, *[pa.array(np.ascontiguousarray(z[:, k])) for k in range(z.shape[1])]], names)

    return tidy(run)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector is there and whose entries are all finite numbers."""
    c = F.col("embedding")
    fine = F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    return vectors.filter(c.isNotNull() & fine).select(F.col("vec_id"), F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("x"))


def whiten(vectors: DataFrame) -> DataFrame:
    """A row for each remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue.

    vectors: vec_id, embedding (a list of numbers); other columns are ignored. Vectors that are null or
    hold a null, NaN or infinite entry are left out; repeated ids and vectors keep their rows, but the
    fit takes each distinct vector once. Vectors shorter than the longest one count 0 in what they lack;
    if all are empty there are no components. With fewer than four dimensions there are as many
    components as dimensions. A component without variance (one distinct vector, or dependent
    dimensions) has whitened null and no part in identity_error, which is null if no component has any;
    explained is null if there is no variance at all. deviation is null where it exceeds a long.
    No rows give no rows. The driver holds d x d numbers for d dimensions.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows = whole_numbers(vectors)
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    width = fit.agg(F.max(F.size("x"))).first()[0] or 0
    if width == 0:
        return spark.createDataFrame([], f"vec_id long, {schema}")
    got = fit.mapInArrow(_sums(width), "i int, high long, low long, most long, n long").groupBy("i").agg(F.sum("high"), F.sum("low"), F.max("most"), F.sum("n")).orderBy("i").collect()
    n, most = got[0][4], max(r[3] for r in got)
    sums = [(r[1] << LOW_BITS) + r[2] for r in got]
    mean = np.array([s / n for s in sums])
    v = np.zeros((width, width))
    for i, j, x in fit.mapInArrow(_products(mean), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        v[i, j] = v[j, i] = x / n
    trace = float(np.trace(v))
    found = leading(v)
    least = max((c.value for c in found), default=0.0) * width * 1e-14
    sound = [c.value > least for c in found]
    axes = np.column_stack([c.vector / math.sqrt(c.value) if ok else np.zeros(width) for c, ok in zip(found, sound, strict=True)])
    names = [f"z{k}" for k in range(len(found))]
    z_schema = "".join(f", {z} double" for z in names)
    of_fit = fit.mapInArrow(_projected(0, mean, axes, sums, n, most, ["deviation", *names]), f"deviation long{z_schema}")
    pairs = [(i, j) for i in range(len(found)) for j in range(i, len(found)) if sound[i] and sound[j]]
    error = None
    if pairs:
        covariance = of_fit.agg(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
    out = rows.mapInArrow(_projected(1, mean, axes, sums, n, most, ["vec_id", "deviation", *names]), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long{z_schema}")
    each = [
        F.struct(
            F.lit(k + 1).alias("component"),
            (F.col(names[k]) if ok else F.lit(None).cast("double")).alias("whitened"),
            F.lit(max(c.value, 0.0) / trace if trace > 0 else None).cast("double").alias("explained"),
            F.lit(max(c.value, 0.0)).alias("eigenvalue"),
        )
        for k, (c, ok) in enumerate(zip(found, sound, strict=True))
    ]
    out = out.select("vec_id", "deviation", F.explode(F.array(*each)).alias("c"))
    return out.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"), "c.eigenvalue")
