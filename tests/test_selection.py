"""Bracket selection against sorting, at sizes where one round, several rounds or no round is needed."""

import random

import numpy as np
import pytest

from lapse.operators.selection import exact_quantiles, values_at_ranks


def _table(spark, n, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([5.0, rnd.uniform(0, 100), rnd.gauss(0, 1e6)]) if rnd.random() < 0.95 else None, rnd.randint(-3, 3), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "x double, y int, z long").repartition(5)


@pytest.mark.parametrize("accuracy, limit", [(10_000, 50_000), (50, 40), (7, 10), (2, 1)])
def test_every_rank(spark, accuracy, limit):
    rows, df = _table(spark, 3000, 1)
    ask = lambda n: [0, 1, n // 3, n // 2, n // 2 + 1, n - 2, n - 1, n + 5, -1]
    found = values_at_ranks(df, {c: ask for c in "xyz"}, accuracy, limit)
    for j, c in enumerate("xyz"):
        values = sorted(r[j] for r in rows if r[j] is not None)
        assert found[c] == (len(values), {r: float(values[r]) for r in ask(len(values)) if 0 <= r < len(values)})


def test_quantiles_match_numpy(spark):
    rows, df = _table(spark, 2000, 2)
    probs = [0.0, 0.001, 0.2, 0.5, 0.77, 1.0]
    got = {(r.column_name, r.p): r.value for r in exact_quantiles(df, ["x", "y"], probs, 100, 50).collect()}
    for j, c in ((0, "x"), (1, "y")):
        values = [r[j] for r in rows if r[j] is not None]
        for p in probs:
            assert got[c, p] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12, abs=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert [(r.column_name, r.value) for r in exact_quantiles(df, ["x", "y"], [0.5]).collect()] == [("x", None), ("y", 1.0)]
    assert values_at_ranks(df.limit(0), {"y": lambda n: [0]}) == {"y": (0, {})}


def test_a_value_that_a_third_of_the_rows_hold(spark):
    df = spark.range(9000).selectExpr("IF(id % 3 = 0, 7.0D, CAST(id AS DOUBLE)) AS x")
    values = sorted(7.0 if i % 3 == 0 else float(i) for i in range(9000))
    found = values_at_ranks(df, {"x": lambda n: range(0, n, 900)}, 100, 20)["x"][1]
    assert found == {r: values[r] for r in range(0, 9000, 900)}


def test_only_the_bracket_is_grouped(spark, monkeypatch):
    """Of 200,000 distinct values, the last step groups those of the bracket alone."""
    from lapse.operators import selection
    grouped, holds = [], selection._Bracket.holds
    monkeypatch.setattr(selection._Bracket, "holds", lambda b: grouped.append(b.inside) or holds(b))
    df = spark.range(200_000).selectExpr("CAST(id AS DOUBLE) AS x")
    assert values_at_ranks(df, {"x": lambda n: [n // 2]}, 1000, 500)["x"][1] == {100_000: 100_000.0}
    assert grouped[-1] <= 2000


def test_intermediate_tables_are_released(spark):
    """What only an eager step reads is deleted after it; inputs are never touched."""
    import os
    from lapse import session
    df = session.materialize(spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x"), "kept")
    before = set(session._WRITTEN)
    exact_quantiles(df, ["x"], [0.5]).collect()
    assert set(session._WRITTEN) == before and all(os.path.isdir(p.removeprefix("file://")) for p in before if "/kept-" in p)
    session.release(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    assert os.path.exists("/root/testdata/sf0.001/orders.parquet")
    session.release(df)
    assert not any("/kept-" in p for p in session._WRITTEN)


def test_a_bracket_of_one_value_takes_no_further_round(spark, monkeypatch):
    """A column of four values: each bracket of a round holds one of them, so nothing is sketched again or grouped."""
    from lapse.operators import selection
    rounds, narrow = [], selection._narrow
    monkeypatch.setattr(selection, "_narrow", lambda df, brackets, accuracy: rounds.append(len(brackets)) or narrow(df, brackets, accuracy))
    monkeypatch.setattr(selection, "_grouped", lambda *_: pytest.fail("rows were grouped"))
    df = spark.range(8000).selectExpr("IF(id % 4 = 0, -0.0D, CAST(id % 4 AS DOUBLE)) AS x")
    found = values_at_ranks(df, {"x": lambda n: [500, 3000, 5000, 7000]}, 1000, 100)["x"][1]
    assert found == {500: 0.0, 3000: 1.0, 5000: 2.0, 7000: 3.0} and str(found[500]) == "0.0" and rounds == [1]


def test_nan_is_the_largest_value(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, DOUBLE('NaN'), CAST(id AS DOUBLE)) AS x")
    found = values_at_ranks(df, {"x": lambda n: [0, 1000, 1999, 2500]}, 50, 20)["x"][1]
    values = sorted(float(i) for i in range(3000) if i % 3)
    assert [found[r] for r in (0, 1000, 1999)] == [values[0], values[1000], values[1999]] and found[2500] != found[2500]
