"""RFM rules, Box-Cox searches, label codes, chi-square."""

import datetime as dt
import math
import random

import numpy as np

from lapse.functions.rfm import rfm_segment, value_tier
from lapse.operators import rfm as rf
from lapse.operators import stats as st


def test_every_segment_code_has_one_label(spark):
    df = spark.createDataFrame([(r, f) for r in range(1, 6) for f in range(1, 6)], "R int, F int")
    out = df.select("R", "F", rfm_segment("R", "F").alias("s")).collect()
    assert len(out) == 25 and all(r.s is not None for r in out)
    by = {(r.R, r.F): r.s for r in out}
    assert by[(5, 5)] == "Чемпионы" and by[(1, 1)] == "Спящие" and by[(4, 2)] == "Potential loyalists"


def test_tiers_boundaries(spark):
    df = spark.createDataFrame([(s,) for s in range(3, 16)], "s int")
    t = {r.s: r.t for r in df.select("s", value_tier("s").alias("t")).collect()}
    assert t[5] == "Стандарт" and t[6] == "Бронза" and t[8] == "Серебро" and t[10] == "Золото" and t[11] == "Платина"


def test_scores_monotone(spark):
    rnd = random.Random(5)
    rows = [(f"c{i}", rnd.randint(0, 300), rnd.randint(1, 6), rnd.uniform(1, 1000)) for i in range(500)]
    df = spark.createDataFrame(rows, "customer_unique_id string, Recency long, Frequency long, MonetaryValue double")
    s = rf.rfm_scores(df).collect()
    for a in s:
        for b in s[:50]:
            if a.Recency < b.Recency:
                assert a.R >= b.R
            if a.MonetaryValue < b.MonetaryValue:
                assert a.M <= b.M
    assert all(r.RFM_Score == r.R + r.F + r.M for r in s)


def test_fan_out_monetary(spark):
    """2 reviews x 2 payments x 2 equal items; the row grain sums the
    fanned-out fact after duplicate removal, the payment grain once each."""
    t = dt.datetime(2021, 5, 1)
    rows = []
    for rv in ("r1", "r2"):
        for pay in (("credit_card", 1, 30.0), ("voucher", 1, 10.0)):
            for _item in range(2):
                rows.append(("c1", "o1", t, t, rv, "p1", 50.0) + pay)
    df = spark.createDataFrame(rows, "customer_unique_id string, order_id string, order_approved_at timestamp, "
                                     "order_purchase_timestamp timestamp, review_id string, product_id string, "
                                     "price double, payment_type string, payment_installments long, payment_value double")
    dedup = df.dropDuplicates()
    assert dedup.count() == 4                                # equal items collapse
    assert rf.rfm_base(dedup).first().MonetaryValue == 80.0  # 2 reviews x (30 + 10)
    assert rf.rfm_base(dedup, grain="payment").first().MonetaryValue == 40.0


def _watched(df, seen):
    """``df``, whose rows are added to the accumulator ``seen`` each time that they are made."""
    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(note, df.schema)


def test_rfm_aggregates_the_fact_once(spark):
    rnd = random.Random(12)
    start = dt.datetime(2020, 1, 1)
    rows = [(f"c{i % 40}", f"o{i}", start + dt.timedelta(hours=rnd.randrange(9000)), rnd.uniform(1, 500)) for i in range(300)] + [(None, "o", start, 1.0)]
    fact = spark.createDataFrame(rows, "customer_unique_id string, order_id string, order_approved_at timestamp, payment_value double")
    seen = spark.sparkContext.accumulator(0)
    got = rf.rfm(_watched(fact, seen)).orderBy("customer_unique_id").collect()
    assert seen.value <= 2 * len(rows)  # the measures and the latest date, each once
    scored = rf.rfm_labels(rf.rfm_scores(rf.rfm_base(fact))).orderBy("customer_unique_id").collect()
    assert got == scored and len(got) == 40
    stored = rf.rfm_base(fact)
    assert rf.rfm(None, base=stored).orderBy("customer_unique_id").collect() == got


def test_skewness_report_reads_its_input_once(spark):
    rnd = random.Random(13)
    data = {"x": [math.exp(rnd.gauss(2, 0.7)) for _ in range(400)], "z": [float(rnd.randrange(9)) for _ in range(399)] + [None]}
    df = spark.createDataFrame(list(zip(*data.values())), "x double, z double")
    seen = spark.sparkContext.accumulator(0)
    got = st.skewness_report(_watched(df, seen), ["x", "z"]).collect()
    assert seen.value == 400
    assert [(r["column_name"], r["transform"]) for r in got] == [("x", t) for t in ("raw", "log", "sqrt", "boxcox")] + [("z", t) for t in ("raw", "log", "sqrt")]
    lam = st.boxcox_lambda(df, "x")
    forms = {"raw": lambda v: v, "log": lambda v: np.log(v + 0.1), "sqrt": np.sqrt, "boxcox": lambda v: (v ** lam - 1) / lam}
    for r in got:
        v = forms[r["transform"]](np.array([v for v in data[r["column_name"]] if v is not None]))
        g1 = ((v - v.mean()) ** 3).mean() / v.std() ** 3
        n = len(v)
        assert r["n"] == n and abs(r["skewness"] - g1) < 1e-4
        assert abs(r["skewness_adj"] - g1 * math.sqrt(n * (n - 1)) / (n - 2)) < 1e-4


def _llf(x, lam):
    x = np.asarray(x, float)
    y = np.log(x) if lam == 0 else (x ** lam - 1) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())


def test_boxcox_mle_is_a_maximum(spark):
    rnd = random.Random(9)
    xs = [math.exp(rnd.gauss(3, 0.8)) for _ in range(800)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    lam = st.boxcox_lambda(df, "x")
    assert _llf(xs, lam) >= _llf(xs, lam + 0.01) and _llf(xs, lam) >= _llf(xs, lam - 0.01)
    grid = {r["lambda"]: r["llf"] for r in st.boxcox_llf_grid(df, "x", [-0.5, 0.0, 0.5]).collect()}
    for g, v in grid.items():
        assert abs(v - _llf(xs, g)) < 1e-6 * abs(v)


def _ppcc(x, lam):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    v = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    v[-1] = 0.5 ** (1 / n)
    v[0] = 1 - v[-1]
    osm = st.norm_ppf(v)
    y = np.log(x) if lam == 0 else (x ** lam - 1) / lam
    return np.corrcoef(osm, y)[0, 1]


def test_norm_ppf_accuracy():
    from statistics import NormalDist
    ps = np.array([1e-6, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 0.999999])
    exact = np.array([NormalDist().inv_cdf(p) for p in ps])
    assert np.max(np.abs(st.norm_ppf(ps) - exact)) < 1e-9


def test_boxcox_ppcc_is_a_maximum(spark):
    rnd = random.Random(13)
    xs = [round(math.exp(rnd.gauss(2, 0.7)), 1) for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    lam = st.boxcox_normmax(df, "x")
    assert _ppcc(xs, lam) >= _ppcc(xs, lam + 0.01) - 1e-12 and _ppcc(xs, lam) >= _ppcc(xs, lam - 0.01) - 1e-12
    # the distributed correlation equals the brute force one
    osm = st.osm_sums(df, "x")
    r = st.boxcox_ppcc_grid(osm, [0.3])[0]
    assert abs(r - _ppcc(xs, 0.3)) < 1e-9


def test_label_codes_sorted_text_and_nan(spark):
    df = spark.createDataFrame([(10,), (2,), (None,), (2,)], "v long")
    out = sorted(r.v_code for r in st.label_encode(df, ["v"]).collect())
    codes = {r.v: r.v_code for r in st.label_encode(df, ["v"]).collect()}
    assert codes[10] == 0 and codes[2] == 1 and codes[None] == 2   # '10' < '2' < 'nan'
    assert out == [0, 1, 1, 2]


def test_chi2_against_formula(spark):
    rows = [(0, 1), (0, 2), (1, 0), (1, 3), (1, 1)]
    df = spark.createDataFrame(rows, "y int, x int")
    r = st.chi2_scores(df, ["x"], "y").first()
    obs = {0: 3.0, 1: 4.0}
    tot, n = 7.0, 5
    exp = {0: 2 / n * tot, 1: 3 / n * tot}
    chi = sum((obs[k] - exp[k]) ** 2 / exp[k] for k in obs)
    assert abs(r.chi2 - chi) < 1e-12
    assert abs(r.p_value - math.erfc(math.sqrt(chi / 2))) < 1e-12


def test_llf_grid_reads_its_input_once(spark, tmp_path):
    spark.range(1, 300).selectExpr("CAST(id % 50 + 1 AS DOUBLE) AS x").write.parquet(str(tmp_path / "xs"))
    grid = st.boxcox_llf_grid(spark.read.parquet(str(tmp_path / "xs")), "x", [0.0, 0.5])
    assert str(tmp_path) not in grid._jdf.queryExecution().toString()
    xs = [float(i % 50 + 1) for i in range(1, 300)]
    assert all(abs(r["llf"] - _llf(xs, r["lambda"])) < 1e-6 * abs(r["llf"]) for r in grid.collect())
