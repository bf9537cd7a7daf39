"""Property tests for report and profile aggregates."""

import random

import numpy as np
from pyspark.sql import functions as F

from lapse.operators import profile as pf
from lapse.operators import report as rp
from lapse.operators import rfm as rf


def _data(spark, n=700, seed=3):
    rnd = random.Random(seed)
    rows = [(f"c{i % 97}", rnd.choice(["A", "B", "C", None]), rnd.randint(3, 15), rnd.gauss(10, 3), rnd.randint(0, 1))
            for i in range(n)]
    return spark.createDataFrame(rows, "customer_unique_id string, state string, score int, x double, is_churned int")


def test_histogram_counts_sum_and_edges(spark):
    df = _data(spark)
    h = rp.histogram(df, "x", 30).collect()
    assert sum(r["count"] for r in h) == 700
    xs = [r.x for r in df.collect()]
    counts, edges = np.histogram(xs, bins=30)
    got = {r.bin: r["count"] for r in h}
    assert [got.get(i, 0) for i in range(30)] == counts.tolist()
    assert abs(min(r.lower for r in h) - edges[0]) < 1e-9


def test_density_integrates_to_one(spark):
    df = _data(spark)
    d = sorted((r.x, r.density) for r in rp.density(df, "x", 200).collect())
    xs = np.array([a for a, _ in d])
    ys = np.array([b for _, b in d])
    area = float(np.sum((ys[1:] + ys[:-1]) / 2 * np.diff(xs)))
    assert 0.9 < area <= 1.0


def test_hierarchy_totals_add_up(spark):
    df = _data(spark).withColumn("Segment", F.col("state")).withColumn("Score", (F.col("score") % 3).cast("string"))
    h = rf.segment_hierarchy(df, ["is_churned", "Segment", "Score"]).collect()
    root = [r for r in h if r.level_id == 7]
    assert len(root) == 1 and root[0].Count == 700
    assert sum(r.Count for r in h if r.level_id == 3) == 700
    assert sum(r.Count for r in h if r.level_id == 0) == 700


def test_category_profile_top_n(spark):
    df = _data(spark)
    p = pf.category_profile(df, ["state", "customer_unique_id"], n=2).collect()
    st = [r for r in p if r.column_name == "state"]
    assert st[0].distinct_values == 3 and len(st) == 2
    counts = df.where(F.col("state").isNotNull()).groupBy("state").count().orderBy(F.desc("count"), "state").collect()
    assert [(r.value, r["count"]) for r in sorted(st, key=lambda r: r["rank"])] == [(c.state, c["count"]) for c in counts[:2]]
    g = {r.column_name: r.non_null for r in pf.group_column_counts(df, ["is_churned"], ["state"]).collect()}
    assert set(g) == {"state"}


def test_churn_by_units(spark):
    df = _data(spark)
    rows = rp.churn_by(df.where(F.col("state").isNotNull()), ["state"]).collect()
    assert sum(r.n for r in rows) == df.where(F.col("state").isNotNull()).count()
    cust = rp.churn_by(df, ["state"], unit="customer").collect()
    want = df.where(F.col("state").isNotNull()).select("state", "customer_unique_id").distinct().groupBy("state").count().collect()
    assert {r.state: r.n for r in cust} == {r.state: r["count"] for r in want}
