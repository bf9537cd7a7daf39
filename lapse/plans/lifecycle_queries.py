"""Registered queries: churn labels and repeat-purchase figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.functions.time import ts_text
from lapse.operators import lifecycle as lc
from lapse.plans.registry import register, with_ctes
from lapse.sources.roles import Roles, base_table

R6 = 6  # digits kept on derived doubles in compared results

# --- inputs -----------------------------------------------------------------


def orders_input(spark, sf_dir, sparse: bool = False):
    o = base_table(spark, sf_dir, "orders")
    if sparse:
        o = o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    return o.select(F.col("o_custkey").alias("customer_unique_id"),
                    F.col("o_orderkey").alias("order_id"),
                    F.col("o_orderdate").alias("order_purchase_timestamp"))


def events_input(spark, sf_dir):
    e = base_table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return e.select(F.col("user_id").alias("customer_unique_id"),
                    F.col("event_id").alias("order_id"),
                    F.col("ts").alias("order_purchase_timestamp"))


SRC_ORDERS = "SELECT o_custkey AS k, o_orderkey AS o, o_orderdate AS ts FROM orders"
SRC_SPARSE = SRC_ORDERS + " WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"
SRC_EVENTS = "SELECT user_id AS k, event_id AS o, ts FROM events WHERE event_type = 'purchase'"


def _label_ctes(src: str, p: str = "") -> list[tuple[str, str]]:
    """Churn-label CTEs over ``src(k, o, ts)``; names get prefix ``p``."""
    return [
        (f"{p}src", src),
        (f"{p}pts", f"SELECT k, o, ts, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY k ORDER BY ts, o))) / 86400000000.0) AS gap FROM {p}src"),
        (f"{p}feat", f"SELECT k, max(ts) AS last_ts, count(DISTINCT o) AS order_count, quantile_cont(gap, 0.5) AS med FROM {p}pts GROUP BY k"),
        (f"{p}ad", f"SELECT max(ts) + INTERVAL 1 DAY AS ad FROM {p}src"),
        (f"{p}thr", f"SELECT avg(med) AS threshold FROM {p}feat"),
        (f"{p}lab", f"SELECT k, last_ts, order_count, med, threshold, CAST(floor((epoch_us(ad) - epoch_us(last_ts)) / 86400000000.0) AS BIGINT) AS days_since FROM {p}feat, {p}ad, {p}thr"),
        (f"{p}lab2", f"SELECT *, CAST(coalesce(days_since > CASE WHEN order_count = 1 OR med IS NULL OR med <= 0 THEN threshold ELSE med * 2.0 END, false) AS INTEGER) AS is_churned FROM {p}lab"),
    ]


def _label_sql(src: str) -> str:
    return with_ctes(_label_ctes(src), (
        "SELECT k AS customer_unique_id, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_order_date, "
        "CAST(order_count AS BIGINT) AS order_count, med AS median_interval_days, "
        "days_since AS days_since_last_order, round(threshold, 6) AS threshold, is_churned FROM lab2"))


def _labels_out(df):
    return lc.churn_labels(df).select(
        "customer_unique_id", ts_text("last_order_date").alias("last_order_date"),
        "order_count", "median_interval_days", "days_since_last_order",
        F.round("threshold", R6).alias("threshold"), "is_churned")


@register("churn_label_orders", _label_sql(SRC_ORDERS))
def churn_label_orders(spark, sf_dir):
    return _labels_out(orders_input(spark, sf_dir))


@register("churn_label_sparse", _label_sql(SRC_SPARSE))
def churn_label_sparse(spark, sf_dir):
    return _labels_out(orders_input(spark, sf_dir, sparse=True))


@register("churn_label_events", _label_sql(SRC_EVENTS))
def churn_label_events(spark, sf_dir):
    return _labels_out(events_input(spark, sf_dir))


CHURN_BY_NATION_SQL = with_ctes(
    _label_ctes(SRC_ORDERS) + [("cn", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")],
    "SELECT n_name AS customer_state, CAST(count(*) AS BIGINT) AS customers, "
    "CAST(sum(is_churned) AS BIGINT) AS churned, round(avg(is_churned), 6) AS churn_rate "
    "FROM lab2 JOIN cn ON k = c_custkey GROUP BY n_name")


def churn_rate_by_state(spark, sf_dir):
    """Flagship slice: label customers from their orders, then churn rate per
    nation (scan, join, gap windows, median, global scalar, condition,
    back-join, group)."""
    labels = lc.churn_labels(orders_input(spark, sf_dir))
    c = base_table(spark, sf_dir, "customer")
    n = base_table(spark, sf_dir, "nation")
    cn = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("customer_unique_id"), F.col("n_name").alias("customer_state"))
    return (labels.join(cn, "customer_unique_id")
            .groupBy("customer_state")
            .agg(F.count("*").alias("customers"),
                 F.sum("is_churned").cast("bigint").alias("churned"),
                 F.round(F.avg("is_churned"), R6).alias("churn_rate"))
            .orderBy(F.desc("churn_rate"), "customer_state"))


register("churn_rate_by_state", CHURN_BY_NATION_SQL)(churn_rate_by_state)


@register("analysis_date", with_ctes([], (
    "SELECT strftime(max(order_purchase_timestamp) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS analysis_date FROM r_orders"),
    roles=["r_orders"]))
def q_analysis_date(spark, sf_dir):
    return lc.analysis_date(Roles(spark, sf_dir).orders()).select(
        ts_text("analysis_date").alias("analysis_date"))


@register("customer_intervals", with_ctes(_label_ctes(SRC_EVENTS), (
    "SELECT k AS customer_unique_id, med AS median_interval_days FROM feat WHERE med IS NOT NULL")))
def q_customer_intervals(spark, sf_dir):
    return lc.customer_intervals(events_input(spark, sf_dir))


@register("churn_threshold", with_ctes(_label_ctes(SRC_ORDERS), (
    "SELECT round(threshold, 6) AS threshold FROM thr")))
def q_churn_threshold(spark, sf_dir):
    feats = lc.customer_features(orders_input(spark, sf_dir))
    return lc.global_threshold(feats).select(F.round("threshold", R6).alias("threshold"))


@register("order_gaps", with_ctes([("src", SRC_EVENTS)], (
    "SELECT k AS customer_unique_id, o AS order_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY k ORDER BY ts, o))) / 86400000000.0) AS BIGINT) AS gap_days FROM src")))
def q_order_gaps(spark, sf_dir):
    return lc.order_gaps(events_input(spark, sf_dir)).select(
        "customer_unique_id", "order_id", "gap_days")


@register("gap_histogram", with_ctes(_label_ctes(SRC_EVENTS), (
    "SELECT k AS customer_unique_id, CAST(gap AS BIGINT) AS gap_days, CAST(count(*) AS BIGINT) AS n FROM pts WHERE gap IS NOT NULL GROUP BY k, gap")))
def q_gap_histogram(spark, sf_dir):
    return lc.gap_histogram(events_input(spark, sf_dir))


ORDERS_CUST = "SELECT o.order_id, c.customer_unique_id FROM r_orders o JOIN r_customers c ON o.customer_id = c.customer_id"


@register("repeat_customers", with_ctes([("oc", ORDERS_CUST),
                                         ("per", "SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM oc GROUP BY 1")], (
    "SELECT CAST((SELECT count(*) FROM per WHERE n > 1) AS BIGINT) AS repeat_customers, "
    "CAST((SELECT count(*) FROM oc) AS BIGINT) AS order_rows, "
    "round((SELECT count(*) FROM per WHERE n > 1) / (SELECT count(*) FROM oc) * 100, 6) AS repeat_share_pct"),
    roles=["r_orders", "r_customers"]))
def q_repeat_customers(spark, sf_dir):
    r = Roles(spark, sf_dir)
    oc = r.orders().join(r.customers(), "customer_id").select("order_id", "customer_unique_id")
    return lc.repeat_customers(oc).withColumn("repeat_share_pct", F.round("repeat_share_pct", R6))


@register("order_quantity", with_ctes([("oc", ORDERS_CUST)], (
    "SELECT order_id, customer_unique_id, CAST(count(DISTINCT order_id) OVER (PARTITION BY customer_unique_id) AS BIGINT) AS quantity FROM oc"),
    roles=["r_orders", "r_customers"]))
def q_order_quantity(spark, sf_dir):
    r = Roles(spark, sf_dir)
    oc = r.orders().join(r.customers(), "customer_id").select("order_id", "customer_unique_id")
    return lc.with_order_count(oc)
