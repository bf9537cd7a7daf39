"""Time semantics (T1, T10), churn labels (G2) and their skew-safe gaps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lapse.functions.time import calendar_days, elapsed_days, elapsed_seconds
from lapse.operators import lifecycle as lc
from lapse.sources.tables import parse_ts

from conftest import SF_MID, SF_SMALL


def test_floored_days_negative_half_day(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 0), dt.datetime(2020, 1, 1, 12)),
                                (dt.datetime(2020, 1, 2, 12), dt.datetime(2020, 1, 1, 0)),
                                (dt.datetime(2020, 1, 1, 0), dt.datetime(2020, 1, 3, 0))], "a timestamp, b timestamp")
    out = df.select(elapsed_days("a", "b").alias("d"), elapsed_seconds("a", "b").alias("s"),
                    calendar_days("a", "b").alias("c")).collect()
    assert [r.d for r in out] == [-1, 1, -2]          # -12 h floors to -1 day
    assert [r.s for r in out] == [-43200.0, 129600.0, -172800.0]
    assert [r.c for r in out] == [0, 1, -2]


def test_parse_strict_and_coerce(spark):
    df = spark.createDataFrame([("2020-01-01 10:00:00",), ("not a date",), (None,)], "t string")
    coerced = parse_ts(df, ["t"], "coerce").collect()
    assert coerced[0].t == dt.datetime(2020, 1, 1, 10) and coerced[1].t is None and coerced[2].t is None
    with pytest.raises(Exception):
        parse_ts(df, ["t"], "strict").collect()


def test_churn_label_branches(spark):
    # customer a: one order, long idle -> global threshold
    # customer b: two rows of one order (two reviews) -> median 0 -> fallback
    # customer c: regular every 10 days, idle 25 days -> 25 > 2*10 -> churned
    # customer d: regular every 10 days, idle 5 days -> not churned
    base = dt.datetime(2021, 1, 1)
    data = [("a", "a1", base)]
    data += [("b", "b1", base + dt.timedelta(days=50)), ("b", "b1", base + dt.timedelta(days=50))]
    data += [("c", f"c{i}", base + dt.timedelta(days=10 * i)) for i in range(5)]      # last day 40
    data += [("d", f"d{i}", base + dt.timedelta(days=20 + 10 * i)) for i in range(6)]  # last day 70
    df = spark.createDataFrame(data, "customer_unique_id string, order_id string, order_purchase_timestamp timestamp")
    lab = {r.customer_unique_id: r for r in lc.churn_labels(df, ranges=3).collect()}
    # analysis date = day 71; medians: b 0, c 10, d 10 -> threshold = 20/3
    assert lab["c"].median_interval_days == 10.0 and lab["b"].median_interval_days == 0.0
    assert lab["a"].median_interval_days is None
    assert abs(lab["a"].threshold - 20 / 3) < 1e-9
    assert lab["a"].days_since_last_order == 71 and lab["a"].is_churned == 1
    assert lab["b"].order_count == 1 and lab["b"].days_since_last_order == 21 and lab["b"].is_churned == 1
    assert lab["c"].days_since_last_order == 31 and lab["c"].is_churned == 1
    assert lab["d"].days_since_last_order == 1 and lab["d"].is_churned == 0


def test_gap_histogram_hot_customer_matches_plain_lag(spark):
    """A customer holding a third of all rows: bucketed gaps equal lag gaps."""
    rnd = random.Random(7)
    base = dt.datetime(2022, 1, 1)
    data = []
    for i in range(1200):
        data.append(("hot", f"h{i}", base + dt.timedelta(hours=rnd.randint(0, 24 * 400))))
    for c in range(300):
        for j in range(rnd.randint(1, 8)):
            data.append((f"c{c}", f"c{c}_{j}", base + dt.timedelta(hours=rnd.randint(0, 24 * 400))))
    data.append(("hot", "h0", data[0][2]))  # repeated row -> zero gap
    df = spark.createDataFrame(data, "customer_unique_id string, order_id string, order_purchase_timestamp timestamp")
    fast = {(r[0], r[1]): r[2] for r in lc.gap_histogram(df, ranges=5).collect()}
    plain = (lc.order_gaps(df).where(F.col("gap_days").isNotNull())
             .groupBy("customer_unique_id", "gap_days").count().collect())
    assert fast == {(r[0], r[1]): r[2] for r in plain}


def test_slice_values_sf0001(spark):
    """Survey 7.2: all orders at sf0.001 -> 150 customers, threshold 178.75, rate 0.28."""
    from lapse.plans.lifecycle_queries import orders_input
    lab = lc.churn_labels(orders_input(spark, SF_SMALL))
    r = lab.agg(F.count("*").alias("n"), F.first("threshold").alias("t"), F.avg("is_churned").alias("rate")).first()
    assert r.n == 150 and abs(r.t - 178.75) < 1e-6 and abs(r.rate - 0.28) < 1e-9


def test_slice_values_events_sf001(spark):
    from lapse.plans.lifecycle_queries import events_input
    lab = lc.churn_labels(events_input(spark, SF_MID))
    r = lab.agg(F.count("*").alias("n"), F.first("threshold").alias("t"), F.avg("is_churned").alias("rate")).first()
    assert r.n == 150 and abs(r.t - 1.1067) < 1e-4 and abs(r.rate - 0.326667) < 1e-6


def test_slice_values_sparse_sf001(spark):
    """Survey 7.2: status F + 1-URGENT orders at sf0.01 -> 722 customers,
    threshold 744.7818, 502 fallback customers, churn rate 0.544321."""
    from lapse.plans.lifecycle_queries import orders_input
    lab = lc.churn_labels(orders_input(spark, SF_MID, sparse=True))
    fallback = (F.col("order_count") == 1) | F.col("median_interval_days").isNull() | (F.col("median_interval_days") <= 0)
    r = lab.agg(F.count("*").alias("n"), F.first("threshold").alias("t"), F.count_if(fallback).alias("fb"),
                F.avg("is_churned").alias("rate")).first()
    assert r.n == 722 and abs(r.t - 744.7818) < 1e-4 and r.fb == 502 and abs(r.rate - 0.544321) < 1e-6


def test_row_gaps_do_not_depend_on_ranges(spark):
    rnd = random.Random(21)
    base = dt.datetime(2022, 1, 1)
    data = [("hot", f"h{i}", base + dt.timedelta(hours=rnd.randint(0, 24 * 300))) for i in range(900)]
    data += [(f"c{c}", f"c{c}_{j}", base + dt.timedelta(days=rnd.randint(0, 300))) for c in range(200) for j in range(3)]
    data += [("hot", "dup", data[5][2]), (None, "x", base), ("c1", "y", None)]
    df = spark.createDataFrame(data, "customer_unique_id string, order_id string, order_purchase_timestamp timestamp")
    a = {(r.customer_unique_id, r.order_id): r.gap_days for r in lc.order_gaps(df, ranges=7).collect()}
    b = {(r.customer_unique_id, r.order_id): r.gap_days for r in lc.order_gaps(df, ranges=1).collect()}
    assert a == b and len(a) == len(data)


def test_rows_without_customer_have_no_gap(spark):
    df = spark.createDataFrame([(None, 1, "2020-01-01 00:00:00"), (None, 2, "2020-01-11 00:00:00"), ("a", 3, "2020-01-01 00:00:00"),
                                ("a", 4, "2020-03-01 12:00:00"), ("a", 5, None)], "customer_unique_id string, order_id long, t string")
    df = df.withColumn("order_purchase_timestamp", F.to_timestamp("t")).drop("t")
    for n in (1, 3, 16):
        got = {r.order_id: r.gap_days for r in lc.order_gaps(df, ranges=n).collect()}
        assert got == {1: None, 2: None, 3: None, 4: 60, 5: None}


def test_a_customer_within_minutes_is_spread_over_tasks(spark, monkeypatch):
    """Half the rows are one customer's, all within two days: no task reads them all, no window is keyed by the customer."""
    from lapse.operators import ordered
    base, n = dt.datetime(2022, 5, 1), 4000
    data = [("hot", i, base + dt.timedelta(seconds=37 * (i * 7919 % n))) for i in range(n)] + [(f"c{i % 900}", n + i, base + dt.timedelta(hours=i)) for i in range(n)]
    df = spark.createDataFrame(data, "customer_unique_id string, order_id long, order_purchase_timestamp timestamp").repartition(6)
    stored, keep = [], ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda d, name=None: stored.append(keep(d, name)) or stored[-1])
    out = lc.order_gaps(df, ranges=8)
    per_task = {r["_range"]: r["count"] for r in stored[0].groupBy("_range").count().collect()}
    assert len(per_task) == 8 and max(per_task.values()) < n // 2
    assert stored[0].where("customer_unique_id = 'hot'").select("_range").distinct().count() >= 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(customer_unique_id" not in plan
    last, want = {}, {}
    for c, o, t in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        want[c, o] = (t - last[c]).days if c in last else None
        last[c] = t
    assert {(r.customer_unique_id, r.order_id): r.gap_days for r in out.collect()} == want


def test_previous_row_of_any_type_and_count_of_ranges(spark):
    from lapse.operators.ordered import with_previous
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 3, 4 + i]), rnd.randint(0, 50), rnd.choice([None, f"v{i}"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, t int, v string, i int").repartition(7)
    want, last = {}, {}
    for g, t, v, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        want[i] = last.get(g)
        last[g] = v
    for n in (None, 1, 2, 9, 40):
        assert {r["i"]: r["p"] for r in with_previous(df, "g", ["t", "i"], "v", "p", n).collect()} == want
    assert with_previous(df.limit(0), "g", ["t", "i"], "v", "p").count() == 0


def test_one_range_is_cut_where_a_task_would_sort_too_many_rows(spark, monkeypatch):
    from lapse.operators import ordered
    base, n = dt.datetime(2022, 5, 1), 3000
    data = [(f"c{i % 40}" if i % 3 else "hot", i, base + dt.timedelta(hours=i * 7919 % n)) for i in range(n)]
    df = spark.createDataFrame(data, "customer_unique_id string, order_id long, order_purchase_timestamp timestamp")
    whole = {r.order_id: r.gap_days for r in lc.order_gaps(df, ranges=1).collect()}
    medians = {tuple(r) for r in lc.customer_intervals(df, ranges=1).collect()}
    stored, keep = [], ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda d, name=None: stored.append(keep(d, name)) or stored[-1])
    monkeypatch.setattr(ordered, "RANGE_ROWS", 400)
    assert {r.order_id: r.gap_days for r in lc.order_gaps(df, ranges=1).collect()} == whole
    assert {tuple(r) for r in lc.customer_intervals(df, ranges=1).collect()} == medians
    for table in stored:
        assert table.agg(F.max("n")).first()[0] < n / 3 if "n" in table.columns else max(r["count"] for r in table.groupBy("_range").count().collect()) < n / 3
