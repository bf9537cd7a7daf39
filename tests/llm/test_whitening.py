"""Whitening against exact whole-number sums and numpy's eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.llm.whitening import centre, eigen, whiten


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit(3) for c in ("i", "x", "c", "v", "box", "n", "component", "unit")})


def exact(rows, dims):
    """(id, deviation, centred row as fractions) of valid rows; the fit list's covariance; its size."""
    ok = [(i, [int(np.floor(256 * c)) for c in v] + [0] * (dims - len(v))) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = {tuple(x) for _, x in ok}
    n, total = len(fit), [sum(col) for col in zip(*fit)]
    off = lambda x: [Fraction(n * a - s, n) for a, s in zip(x, total)]
    centred = [off(x) for x in fit]
    cov = np.array([[float(sum(c[a] * c[b] for c in centred) / n) for b in range(dims)] for a in range(dims)])
    return [(i, sum((n * a - s) ** 2 for a, s in zip(x, total)), off(x)) for i, x in ok], cov, n


def check(out, rows, dims, k, least=1e-10):
    want, cov, n = exact(rows, dims)
    got, components = out[0].collect(), sorted(out[1].collect(), key=lambda r: r["component"])
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(k, int((values > least * values[0]).sum()))
    assert [r["component"] for r in components] == list(range(1, k + 1)) and {r["n"] for r in components} == {n}
    units = np.array([r["unit"] for r in components])
    assert np.allclose(units @ units.T, np.eye(k), atol=1e-12)
    assert np.allclose(cov @ units.T, units.T * values[:k], atol=1e-9 * values[0])
    assert np.allclose([r["explained"] for r in components], values[:k] / np.trace(cov), rtol=1e-9)
    assert {r["identity_error"] <= 1e-6 for r in components} == {True}
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    projected = [(i, d, tuple(units @ np.array([float(v) for v in c]) / np.sqrt(values[:k]))) for i, d, c in want]
    seen = [(r["vec_id"], r["deviation"], tuple(r["whitened"])) for r in got]
    assert len(seen) == len(projected)
    for a, b in zip(sorted(seen, key=key), sorted(projected, key=key)):
        assert a[:2] == b[:2] and np.allclose(a[2], b[2], rtol=1e-6, atol=1e-7)


def sample(rng, dims=5):
    mix = rng.normal(size=(dims, dims)) * np.array([5, 3, 2, 1, 0.5])[:dims, None]
    rows = [(i, (rng.normal(size=dims) @ mix + 2).tolist()) for i in range(200)]
    rows += [(i, rows[3][1]) for i in range(200, 300)]  # one vector for a third of the rows
    rows += [(400, None), (401, [None] + [1.0] * (dims - 1)), (402, [float("nan")] * dims), (403, [float("-inf")] * dims), (None, [0.25] * dims),
             (404, [0.3, -0.2]), (405, []), (406, [0.0] * dims), (406, [0.0] * dims), (407, [-0.0] * dims)]
    return rows


def test_whitening_matches_exact_sums(spark):
    rows = sample(np.random.default_rng(1))
    df = table(spark, rows).repartition(3)
    check(whiten(df, "vec_id", "embedding"), rows, 5, 5)
    # many slabs, blocks of few rows and columns: the same rows
    out = whiten(df, "vec_id", "embedding", components=3, carry=["box", "n"], block_values=1, cols_block=2, slab_rows=70)
    assert out[0].columns == ["vec_id", "box", "n", "whitened", "deviation"]
    check(out, rows, 5, 3)


def test_whitening_far_from_zero(spark):
    """A mean a million times the spread loses no digit of the covariance."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * [3, 2, 1] + 4e6).tolist()) for i in range(120)]
    check(whiten(table(spark, rows), "vec_id", "embedding"), rows, 3, 3)


def test_whitening_without_spread(spark):
    """No component without spread; dimensions that depend on others leave fewer components."""
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 1.5])], [(1, [0.5, 1.5]), (2, [0.5, 1.5]), (3, None)]):
        out, components = whiten(table(spark, rows), "vec_id", "embedding", components=4)
        assert out.count() == 0 and components.count() == 0 and out.columns == ["vec_id", "whitened", "deviation"]
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(2 * a), float(b), 7.0]) for i, (a, b) in enumerate(rng.integers(-50, 50, (80, 2)))]
    out = whiten(table(spark, rows), "vec_id", "embedding", components=4)
    assert out[1].count() == 2
    check(out, rows, 4, 4)


def test_whitening_limits(spark):
    with pytest.raises(Exception, match="does not fit in a long"):
        whiten(table(spark, [(1, [1e30]), (2, [2.0])]), "vec_id", "embedding")
    with pytest.raises(ValueError, match="deviation"):
        whiten(table(spark, []).withColumn("deviation", F.lit(1)), "vec_id", "embedding", carry=["deviation"])


def test_centre_is_exact_in_both_forms():
    rng = np.random.default_rng(4)
    for high in (1000, 2 ** 26, 2 ** 27, 2 ** 45):
        x = rng.integers(-high, high, (7, 4)).astype(np.float64)
        total, n = [int(v) for v in x.sum(axis=0)], 7
        q, r = zip(*[divmod(s, n) for s in total])
        try:
            c, deviation = centre(x, list(q), list(r), n)
        except OverflowError:
            assert high == 2 ** 45
            continue
        assert [int(d) for d in deviation] == [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
        assert np.allclose(c, x - np.array(total) / n, rtol=1e-12)


def test_eigen_order_and_sign():
    values, units, trace = eigen(np.diag([2.0, 8.0, 0.0, 4.0]), 2, 1e-10)
    assert values.tolist() == [4.0, 2.0, 1.0] and units.shape == (4, 3) and trace == 7.0
    assert (units[np.abs(units).argmax(axis=0), range(3)] > 0).all()
