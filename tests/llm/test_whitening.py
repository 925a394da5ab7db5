"""Whitening against numpy's eigenvectors and exact sums; the counts of the spectrum."""

import numpy as np
import pytest
from conftest import rows

from tracewright.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def some_symmetric(r, n):
    q = np.linalg.qr(r.standard_normal((n, n)))[0]
    e = r.choice([0.0, 1.0, 1.0, 2.5, -3.0, 1e-6, 7.0], n) if n % 2 else r.standard_normal(n)
    return (q * e) @ q.T, e


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 41, 64])
def test_counts_and_leading_values(n):
    r = np.random.default_rng(n)
    for _ in range(5):
        a, e = some_symmetric(r, n)
        a = (a + a.T) / 2
        for t in (-3.5, -1e-3, 0.3, 1.7, 5.0):
            assert whitening.above(a, t) == (e > t).sum()
        found = whitening.leading(a)
        assert np.allclose([c.value for c in found], sorted(e)[::-1][: len(found)], atol=1e-12)
        x = np.column_stack([c.vector for c in found])
        assert np.allclose(x.T @ x, np.eye(len(found)), atol=1e-9)
        for c in found:
            assert np.linalg.norm(a @ c.vector - c.value * c.vector) < 1e-11


def test_zero_pivots_are_counted():
    assert whitening.negative_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert whitening.negative_pivots(np.zeros((3, 3))) == 0
    assert whitening.negative_pivots(np.array([[0.0, 0, 2], [0, -1, 0], [2, 0, 0]])) == 2


def test_close_eigenvalues_keep_their_numbers():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((12, 12)))[0]
    e = np.array([5 + 3e-9, 5 + 2e-9, 5 + 1e-9, 5, *[1.0] * 8])
    found = whitening.leading((q * e) @ q.T)
    for k, c in enumerate(found):
        assert abs(c.value - e[k]) < 1e-13 and abs(abs(c.vector @ q[:, k]) - 1) < 1e-9


def plain(data):
    keep = [(i, v) for i, v, *_ in data if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in keep), default=0)
    xs = [(i, tuple(int(np.floor(256 * np.float64(np.float32(c)))) for c in v) + (0,) * (d - len(v))) for i, v in keep]
    fit = np.array(sorted(set(x for _, x in xs)), object)
    n, s = len(fit), fit.sum(0)
    centred = (fit - s / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in xs:
        y = [n * a - b for a, b in zip(x, s, strict=True)]
        for k in range(min(4, d)):
            z = (np.array(x, float) - (s / n).astype(float)) @ u[:, -1 - k] / np.sqrt(e[-1 - k])
            out.setdefault((i, k + 1), []).append((n, sum(a * a for a in y), abs(z), e[-1 - k] / e.sum()))
    return out


@pytest.mark.parametrize("width", [2, 5, 24])
def test_whitening_equals_plain(spark, width):
    r = np.random.default_rng(width)
    mix = r.standard_normal((width, width)) * np.linspace(2, 0.5, width)
    data = [(i, [float(c) for c in mix @ r.standard_normal(width)], 3, "x") for i in range(300)]
    data += [(500, data[0][1], 3, "x")] * 40 + [(None, data[1][1], 3, "x"), (501, None, 3, "x"), (502, [None] * width, 3, "x"), (503, [float("nan")] * width, 3, "x"), (504, [float("inf")] + [0.0] * (width - 1), 3, "x"), (505, [-0.0] * (width - 1), 3, "x")]
    got, want = {}, plain(data)
    for g in whitening.whiten(spark.createDataFrame(data, SCHEMA).repartition(5)).collect():
        assert g.identity_error < 1e-9
        got.setdefault((g.vec_id, g.component), []).append((g.n, g.deviation, abs(g.whitened), g.explained))
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert [x[:2] for x in got[k]] == [x[:2] for x in w] and np.allclose(sorted(got[k]), sorted(w), rtol=1e-8, atol=1e-9)


def test_no_variance_no_rows_and_large_numbers(spark):
    assert rows(whitening.whiten(spark.createDataFrame([], SCHEMA))) == []
    assert rows(whitening.whiten(spark.createDataFrame([(1, [], 1, ""), (2, None, 1, "")], SCHEMA))) == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 1, "")], SCHEMA)).collect()
    assert len(one) == 4 and {(g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], 1, "") for k in range(4)], SCHEMA)).collect()
    assert len(flat) == 12 and {g.component for g in flat if g.whitened is not None} == {1} and flat[0].identity_error < 1e-12
    big = whitening.whiten(spark.createDataFrame([(1, [2.0**40, 1.0], 1, ""), (2, [0.0, 0.0], 1, ""), (3, [2.0**40, 1.0], 1, "")], SCHEMA)).collect()
    assert {(g.n, g.deviation) for g in big} == {(2, None)}
