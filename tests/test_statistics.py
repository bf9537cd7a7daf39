"""Order-statistic sums, kernel density, running sums and deletion neighbourhoods against direct computation."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.operators import fuzzy as fz
from lapse.operators import report as rp
from lapse.operators import stats as st
from lapse.operators.ordered import running_sums


def _medians(n):
    u = [(i - 0.3175) / (n + 0.365) for i in range(1, n + 1)]
    u[0], u[-1] = 1 - 0.5 ** (1 / n), 0.5 ** (1 / n)
    return np.array([NormalDist().inv_cdf(x) for x in u])


def test_normal_quantile():
    p = np.concatenate([np.logspace(-290, -1, 400), np.linspace(0.001, 0.999, 999), 1 - np.logspace(-15, -1, 100)])
    assert np.allclose(st.norm_ppf(p), [NormalDist().inv_cdf(float(x)) for x in p], rtol=1e-14, atol=1e-15)


@pytest.mark.parametrize("n", [1, 2, 7, 128, 129, 130, 1000, 20_000])
def test_order_statistic_prefixes(n):
    z = _medians(n) if n > 1 else np.array([0.0])
    s, s2 = st.osm_prefix(np.arange(n + 1), n)
    assert np.allclose(s, np.concatenate([[0], np.cumsum(z)]), atol=1e-8 * max(1, n ** 0.5))
    assert np.allclose(s2, np.concatenate([[0], np.cumsum(z * z)]), atol=1e-8 * max(1, n ** 0.5))


def test_probability_plot_lambda(spark):
    """The search on range sums finds the lambda of a search on all ranks."""
    rng = np.random.default_rng(5)
    x = np.round(np.exp(rng.normal(3, 0.6, 1500)), 1) + 0.1
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    z, v = _medians(len(x)), np.sort(x)

    def rho(lam):
        y = np.log(v) if lam == 0 else (v ** lam - 1) / lam
        return np.corrcoef(z, y)[0, 1]
    grid = np.linspace(-2, 2, 401)
    best = grid[int(np.argmax([rho(g) for g in grid]))]
    fine = np.linspace(best - 0.02, best + 0.02, 4001)
    want = fine[int(np.argmax([rho(g) for g in fine]))]
    assert st.boxcox_normmax(df, "x", rounds=6) == pytest.approx(want, abs=2e-4)
    osm = st.osm_sums(df, "x")
    for lam, r in zip((-0.5, 0.0, 0.7), st.boxcox_ppcc_grid(osm, [-0.5, 0.0, 0.7])):
        assert r == pytest.approx(rho(lam), abs=1e-6)


@pytest.mark.parametrize("tail", [False, True])
def test_density_within_its_bound(spark, tail):
    rnd = random.Random(4)
    x = [rnd.gauss(50, 9) for _ in range(700)] + [60.0] * 300 + ([9e4] if tail else [])  # one far value: most of the range is empty
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double").repartition(4)
    a = np.array(x)
    h = a.std(ddof=1) * len(a) ** -0.2
    got = {r["point"]: r for r in rp.density(df, "x").collect()}
    peak = 1 / (h * math.sqrt(2 * math.pi))
    for i, g in enumerate(np.linspace(a.min(), a.max(), 100)):
        want = np.exp(-0.5 * ((g - a) / h) ** 2).sum() * peak / len(a)
        assert got[i]["x"] == pytest.approx(g) and abs(got[i]["density"] - want) <= 0.05 * 64 ** -4 * peak + 1e-15
    one = rp.density(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 5).collect()
    assert [r["density"] for r in one] == [None] * 5


def test_running_sums(spark):
    rnd = random.Random(8)
    rows = {rnd.uniform(-5, 5): (rnd.randint(0, 9), rnd.randint(0, 3)) for _ in range(400)}
    df = spark.createDataFrame([(v, a, b) for v, (a, b) in rows.items()], "v double, a long, b long").repartition(3)
    want, sa, sb = {}, 0, 0
    for v in sorted(rows):
        want[v] = (sa, sb)
        sa, sb = sa + rows[v][0], sb + rows[v][1]
    for n in (1, 4, 50):
        assert {r["v"]: (r["a_below"], r["b_below"]) for r in running_sums(df, "v", ["a", "b"], n).collect()} == want


def test_deletion_neighbourhood(spark):
    from itertools import combinations
    words = ["", "a", "ab", "aab", "abcde", "éß\U0001F600x"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for k in (0, 1, 2):
        for r in df.select("w", fz.deletions(F.col("w"), k).alias("d")).collect():
            want = {"".join(c for i, c in enumerate(r["w"]) if i not in gone) for n in range(k + 1) for gone in combinations(range(len(r["w"])), n)}
            assert set(r["d"]) == want and len(r["d"]) == len(want)


def test_labels_meet_on_deletions_only(spark):
    """No key is held by most labels, and none is constant: 400 labels with one beginning meet in a few pairs each."""
    rnd = random.Random(2)
    words = [f"department_{''.join(rnd.choice('abcdefghij') for _ in range(8))}" for _ in range(400)]
    words += [w[:-1] for w in words[:40]]
    df = spark.createDataFrame([(w,) for w in words], "c string")
    out = fz.close_labels_levenshtein(df, "c", 2)
    assert out.where("word <> candidate").count() >= 80
    keys = df.select(F.explode(fz.deletions(F.col("c"), 2)).alias("t")).groupBy("t").count()
    assert keys.agg(F.max("count")).first()[0] <= 5
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 1 and "(text#" in joins[0]
