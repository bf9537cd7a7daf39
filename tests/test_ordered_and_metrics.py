"""Distributed exact order statistics against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from lapse.operators import metrics as mt
from lapse.operators.ordered import exact_quantiles, quantiles, value_counts_cumulative


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    xs = [rnd.choice([5.0] * 30 + [rnd.uniform(0, 100) for _ in range(10)]) for _ in range(2000)]
    ys = [rnd.randint(0, 20) for _ in range(2000)]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y long")
    probs = [0.001, 0.2, 0.4, 0.5, 0.6, 0.8, 0.999]
    got = {(r.column_name, r.p): r.value for r in exact_quantiles(df, ["x", "y"], probs, buckets=7).collect()}
    for c, arr in (("x", xs), ("y", ys)):
        for p in probs:
            assert abs(got[(c, p)] - float(np.percentile(arr, p * 100))) < 1e-9
    builtin = {(r.column_name, r.p): r.value for r in quantiles(df, ["x", "y"], probs, "builtin").collect()}
    for k, v in got.items():
        assert abs(builtin[k] - v) < 1e-9


def test_cumulative_counts_text_values(spark):
    words = ["b", "a", "c", "a", "d", "b", "a"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    out = {r.w: (r.cnt, r.cum_before, r.dense_rank) for r in value_counts_cumulative(df, "w", buckets=3).collect()}
    assert out == {"a": (3, 0, 0), "b": (2, 3, 1), "c": (1, 5, 2), "d": (1, 6, 3)}


def _auc_brute(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_and_roc_match_brute_force(spark):
    rnd = random.Random(11)
    ys = [rnd.randint(0, 1) for _ in range(600)]
    ss = [round(rnd.random() * (0.6 + 0.4 * y), 2) for y in ys]
    df = spark.createDataFrame(list(zip(ys, ss)), "label int, score double")
    auc = mt.roc_auc(df).first().roc_auc
    assert abs(auc - _auc_brute(ys, ss)) < 1e-12
    pts = mt.roc_points(df).orderBy("threshold").collect()
    P, N = sum(ys), len(ys) - sum(ys)
    for r in pts:
        if r.threshold == float("inf"):
            assert r.fpr == 0 and r.tpr == 0
            continue
        tp = sum(1 for y, s in zip(ys, ss) if s >= r.threshold and y == 1)
        fp = sum(1 for y, s in zip(ys, ss) if s >= r.threshold and y == 0)
        assert abs(r.tpr - tp / P) < 1e-12 and abs(r.fpr - fp / N) < 1e-12


def test_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    m = mt.classification_metrics(df).first()
    assert m.specificity == 0.0 and m.precision == 1.0 and m.accuracy == 1.0


def test_count_below_binary_search(spark):
    from lapse.functions.util import count_below
    import random as _r
    rnd = _r.Random(8)
    for n in (1, 2, 7, 63, 200):
        cuts = sorted(rnd.choice([rnd.randint(0, 50)] * 3 + [rnd.randint(0, 50)]) for _ in range(n))
        vals = [rnd.randint(-2, 52) for _ in range(60)] + cuts
        df = spark.createDataFrame([(v,) for v in vals], "v long").withColumn("c", F.array(*[F.lit(c) for c in cuts]))
        got = [r.k for r in df.select(count_below("c", "v", n).alias("k")).collect()]
        assert got == [sum(1 for c in cuts if c < v) for v in vals]


def test_money_sums_pass_thirteen_digits(spark):
    from lapse.functions.util import fixed_mean, fixed_sum
    df = spark.range(20_000).select(F.lit(5e8).alias("x"))
    assert df.agg(fixed_sum("x"), fixed_mean("x")).first() == (1e13, 5e8)
    big = spark.range(1000).select(F.lit(1e15).alias("x"))
    assert big.agg(fixed_sum("x")).first()[0] == 1e18


def test_text_codes_do_not_depend_on_buckets_or_exchange_reuse(spark):
    from lapse.operators.stats import label_encode
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") % 700).alias("a"), (F.col("id") % 11).alias("b"))
    want = {v: i for i, v in enumerate(sorted({f"v{i}" for i in range(700)}))}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for buckets in (1, 16):
            got = {(r.a, r.a_code) for r in label_encode(df, ["a", "b"], buckets=buckets).collect()}
            assert got == set(want.items())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
