"""Registered queries: sources, cleaning, joins and the order fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.functions.text import correct_labels, normalize_label
from lapse.functions.time import ts_text
from lapse.operators import clean, profile
from lapse.operators import report as rp
from lapse.plans import fact as fx
from lapse.plans.lifecycle_queries import _label_ctes
from lapse.plans.memo import fingerprint, input_bytes, memo
from lapse.plans.registry import ORACLE, register, with_ctes
from lapse.session import size_shuffles
from lapse.sources.roles import Roles
from lapse.sources.tables import ORDER_TS_COLUMNS, parse_ts

R6 = 6


def fact_parts(spark, sf_dir, preset="notebook"):
    """The order fact for a data folder and preset, built once per input
    version (see :mod:`lapse.plans.memo`). It and all that is built on it
    shuffle the whole input, so partitions are sized for it first."""
    size_shuffles(spark, input_bytes(sf_dir))
    return memo(spark, ("fact", preset, fingerprint(sf_dir)),
                lambda: fx.order_fact(Roles(spark, sf_dir).tables(), preset))


# --- shared oracle CTEs --------------------------------------------------------

ALL_ROLES = ["r_customers", "r_orders", "r_order_items", "r_order_payments", "r_order_reviews",
             "r_products", "r_translation", "r_sellers"]

O_CTE = ("o", "SELECT o.order_id, o.order_status, o.order_purchase_timestamp, o.order_approved_at, "
              "o.order_delivered_carrier_date, o.order_delivered_customer_date, o.order_estimated_delivery_date, "
              "c.customer_unique_id, c.customer_city, c.customer_state FROM r_orders o JOIN r_customers c ON o.customer_id = c.customer_id")
OQ_CTE = ("oq", "SELECT *, count(DISTINCT order_id) OVER (PARTITION BY customer_unique_id) AS quantity FROM o")
M1_NOT_NULL = ("order_id IS NOT NULL AND order_status IS NOT NULL AND order_purchase_timestamp IS NOT NULL AND "
               "order_approved_at IS NOT NULL AND order_delivered_carrier_date IS NOT NULL AND "
               "order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL AND "
               "customer_unique_id IS NOT NULL AND customer_city IS NOT NULL AND customer_state IS NOT NULL AND "
               "quantity IS NOT NULL AND review_creation_date IS NOT NULL AND review_score IS NOT NULL")


def _fact_ctes(preset="notebook"):
    review_id = "r.review_id, " if preset == "notebook" else ""
    id_null = " AND review_id IS NOT NULL" if preset == "notebook" else ""
    prod_null = ("product_id IS NOT NULL AND product_weight_g IS NOT NULL AND product_category_name IS NOT NULL"
                 if preset == "notebook" else "product_category_name IS NOT NULL")
    items_null = (" WHERE order_id IS NOT NULL AND product_id IS NOT NULL AND seller_id IS NOT NULL AND "
                  "price IS NOT NULL AND freight_value IS NOT NULL") if preset == "notebook" else ""
    return [
        O_CTE, OQ_CTE,
        ("m1", f"SELECT * FROM (SELECT oq.*, {review_id}r.review_creation_date, r.review_score FROM oq "
               f"LEFT JOIN r_order_reviews r ON oq.order_id = r.order_id) WHERE {M1_NOT_NULL}{id_null}"),
    ] + _label_ctes("SELECT customer_unique_id AS k, order_id AS o, order_purchase_timestamp AS ts FROM m1", "l_") + [
        ("labeled", "SELECT m1.*, l.is_churned, l.days_since AS days_since_last_order, l.med AS median_interval_days "
                    "FROM m1 LEFT JOIN l_lab2 l ON m1.customer_unique_id = l.k"),
        ("pt", "SELECT p.product_id, p.product_weight_g, lower(trim(t.product_category_name_english)) AS cat0 "
               "FROM r_products p LEFT JOIN r_translation t ON p.product_category_name = t.product_category_name"),
        ("pc", f"SELECT * FROM (SELECT product_id, product_weight_g, CASE cat0 WHEN 'home_confort' THEN 'home_comfort' "
               f"WHEN 'home_appliances_2' THEN 'home_appliances' ELSE cat0 END AS product_category_name FROM pt) WHERE {prod_null}"),
        ("it", f"SELECT * FROM r_order_items{items_null}"),
        ("m2", "SELECT DISTINCT pc.*, it.order_id, it.seller_id, it.price FROM pc LEFT JOIN it ON pc.product_id = it.product_id"),
        ("m3", "SELECT m2.*, s.seller_city, s.seller_state FROM m2 LEFT JOIN r_sellers s ON m2.seller_id = s.seller_id"),
        ("m5", "SELECT DISTINCT l.*, m3.product_id, m3.product_weight_g, m3.product_category_name, m3.seller_id, "
               "m3.price, m3.seller_city, m3.seller_state, p.payment_type, p.payment_installments, p.payment_value "
               "FROM labeled l LEFT JOIN m3 ON l.order_id = m3.order_id LEFT JOIN r_order_payments p ON l.order_id = p.order_id"),
        ("fact", "SELECT *, (epoch_us(order_approved_at) - epoch_us(order_purchase_timestamp)) / 1000000.0 AS approval_delay, "
                 "CAST(floor((epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0) AS BIGINT) AS delivery_time_to_customer_days, "
                 "CAST(floor((epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 86400000000.0) AS BIGINT) AS delivery_delay, "
                 "CAST(floor((epoch_us(order_estimated_delivery_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0) AS BIGINT) AS estimated_delivery_time "
                 "FROM m5 WHERE product_id IS NOT NULL AND payment_type IS NOT NULL AND order_approved_at < order_delivered_customer_date "
                 "AND order_approved_at < order_delivered_carrier_date AND order_delivered_carrier_date < order_delivered_customer_date"),
    ]


def fact_sql(final: str, preset="notebook", extra: list | None = None) -> str:
    return with_ctes(_fact_ctes(preset) + (extra or []), final, roles=ALL_ROLES)


FACT_OUT = ["order_id", "customer_unique_id", "customer_state", "order_status", "quantity", "review_score",
            "is_churned", "days_since_last_order", "median_interval_days", "product_id", "product_weight_g",
            "product_category_name", "seller_id", "price", "seller_city", "seller_state", "payment_type",
            "payment_installments", "payment_value", "approval_delay", "delivery_time_to_customer_days",
            "delivery_delay", "estimated_delivery_time"]


@register("order_fact", fact_sql("SELECT review_id, " + ", ".join(FACT_OUT) + " FROM fact"))
def q_order_fact(spark, sf_dir):
    return fact_parts(spark, sf_dir).fact.select("review_id", *FACT_OUT)


@register("order_fact_app", fact_sql("SELECT " + ", ".join(FACT_OUT) + " FROM fact", preset="app"))
def q_order_fact_app(spark, sf_dir):
    return fact_parts(spark, sf_dir, "app").fact.select(*FACT_OUT)


@register("attach_label", fact_sql(
    "SELECT order_id, review_id, is_churned, days_since_last_order, median_interval_days FROM labeled"))
def q_attach_label(spark, sf_dir):
    return fact_parts(spark, sf_dir).orders_labeled.select(
        "order_id", "review_id", "is_churned", "days_since_last_order", "median_interval_days")


@register("drop_incomplete", fact_sql("SELECT order_id, review_id, review_score, quantity FROM m1"))
def q_drop_incomplete(spark, sf_dir):
    return fact_parts(spark, sf_dir).merge1.select("order_id", "review_id", "review_score", "quantity")


@register("scan_orders", with_ctes([], (
    "SELECT order_id, customer_id, order_status, strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp, "
    "strftime(order_approved_at, '%Y-%m-%d %H:%M:%S') AS order_approved_at FROM r_orders"), roles=["r_orders"]))
def q_scan_orders(spark, sf_dir):
    o = Roles(spark, sf_dir).orders()
    return o.select("order_id", "customer_id", "order_status",
                    ts_text("order_purchase_timestamp").alias("order_purchase_timestamp"),
                    ts_text("order_approved_at").alias("order_approved_at"))


@register("parse_timestamps", with_ctes([], (
    "SELECT order_id, " + ", ".join(
        f"CAST(epoch(CAST(strftime({c}, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)) AS BIGINT) AS {c}" for c in ORDER_TS_COLUMNS)
    + " FROM r_orders"), roles=["r_orders"]))
def q_parse_timestamps(spark, sf_dir):
    """Timestamps written as text, then parsed back leniently (A4)."""
    o = Roles(spark, sf_dir).orders()
    text = o.select("order_id", *[ts_text(c).alias(c) for c in ORDER_TS_COLUMNS])
    parsed = parse_ts(text, ORDER_TS_COLUMNS, "coerce")
    return parsed.select("order_id", *[F.unix_seconds(c).alias(c) for c in ORDER_TS_COLUMNS])


@register("parse_timestamps_strict", ORACLE["parse_timestamps"])
def q_parse_timestamps_strict(spark, sf_dir):
    """The same in strict mode, where a bad text raises (``csv_reviews`` has the lenient mode on bad dates)."""
    o = Roles(spark, sf_dir).orders()
    parsed = parse_ts(o.select("order_id", *[ts_text(c).alias(c) for c in ORDER_TS_COLUMNS]), ORDER_TS_COLUMNS, "strict")
    return parsed.select("order_id", *[F.unix_seconds(c).alias(c) for c in ORDER_TS_COLUMNS])


@register("first_orders", with_ctes([], "SELECT order_id, customer_id FROM r_orders ORDER BY order_id LIMIT 20", roles=["r_orders"]))
def q_first_orders(spark, sf_dir):
    """The first 20 orders by id (F5: the limit is the feature)."""
    return rp.top_n(Roles(spark, sf_dir).orders(), "order_id", 20, ascending=True).select("order_id", "customer_id")


@register("valid_event_order", with_ctes([], (
    "SELECT order_id FROM r_orders WHERE order_approved_at < order_delivered_customer_date AND "
    "order_approved_at < order_delivered_carrier_date AND order_delivered_carrier_date < order_delivered_customer_date"),
    roles=["r_orders"]))
def q_valid_event_order(spark, sf_dir):
    return clean.valid_event_order(Roles(spark, sf_dir).orders()).select("order_id")


@register("delivery_metrics", with_ctes([], (
    "SELECT order_id, (epoch_us(order_approved_at) - epoch_us(order_purchase_timestamp)) / 1000000.0 AS approval_delay, "
    "CAST(floor((epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0) AS BIGINT) AS delivery_time_to_customer_days, "
    "CAST(floor((epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 86400000000.0) AS BIGINT) AS delivery_delay, "
    "CAST(floor((epoch_us(order_estimated_delivery_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0) AS BIGINT) AS estimated_delivery_time "
    "FROM r_orders"), roles=["r_orders"]))
def q_delivery_metrics(spark, sf_dir):
    o = Roles(spark, sf_dir).orders()
    return fx.delivery_metrics(o).select("order_id", "approval_delay", "delivery_time_to_customer_days",
                                         "delivery_delay", "estimated_delivery_time")


@register("join_inner", with_ctes([O_CTE], "SELECT order_id, customer_unique_id, customer_city, customer_state FROM o",
                                  roles=["r_orders", "r_customers"]))
def q_join_inner(spark, sf_dir):
    r = Roles(spark, sf_dir)
    return fx.orders_with_customers(r.orders(), r.customers()).select(
        "order_id", "customer_unique_id", "customer_city", "customer_state")


@register("join_left_reviews", with_ctes([O_CTE], (
    "SELECT o.order_id, r.review_id, r.review_score FROM o LEFT JOIN r_order_reviews r ON o.order_id = r.order_id"),
    roles=["r_orders", "r_customers", "r_order_reviews"]))
def q_join_left_reviews(spark, sf_dir):
    r = Roles(spark, sf_dir)
    o = fx.orders_with_customers(r.orders(), r.customers())
    return fx.with_reviews(o, r.order_reviews()).select("order_id", "review_id", "review_score")


@register("translate_categories", fact_sql("SELECT product_id, product_weight_g, product_category_name FROM "
                                           "(SELECT product_id, product_weight_g, CASE cat0 WHEN 'home_confort' THEN 'home_comfort' "
                                           "WHEN 'home_appliances_2' THEN 'home_appliances' ELSE cat0 END AS product_category_name FROM pt)"))
def q_translate_categories(spark, sf_dir):
    r = Roles(spark, sf_dir)
    return fx.translate_categories(r.products(), r.translation()).select(
        "product_id", "product_weight_g", "product_category_name")


@register("clean_categories", with_ctes([], (
    "SELECT DISTINCT CASE lower(trim(product_category_name_english)) WHEN 'home_confort' THEN 'home_comfort' "
    "WHEN 'home_appliances_2' THEN 'home_appliances' ELSE lower(trim(product_category_name_english)) END AS category "
    "FROM r_translation"), roles=["r_translation"]))
def q_clean_categories(spark, sf_dir):
    t = Roles(spark, sf_dir).translation()
    return t.select(correct_labels(normalize_label("product_category_name_english")).alias("category")).distinct()


_RENAMED = {"blue_anvil": "anvils", "cold_bolt": "bolts", "never_seen": "x"}


@register("corrected_categories", with_ctes([], (
    "SELECT product_id, " + "CASE lower(trim(product_category_name_english)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _RENAMED.items())
    + " ELSE lower(trim(product_category_name_english)) END AS category FROM r_products p LEFT JOIN r_translation t ON p.product_category_name = t.product_category_name"),
    roles=["r_products", "r_translation"]))
def q_corrected_categories(spark, sf_dir):
    """All products with corrections that change some of the categories here."""
    r = Roles(spark, sf_dir)
    return fx.translate_categories(r.products(), r.translation(), _RENAMED).select("product_id", F.col("product_category_name").alias("category"))


@register("product_items", fact_sql("SELECT product_id, order_id, seller_id, price, seller_city, seller_state, product_category_name FROM m3"))
def q_product_items(spark, sf_dir):
    r = Roles(spark, sf_dir)
    products = clean.drop_incomplete(fx.translate_categories(r.products(), r.translation()))
    items = clean.drop_incomplete(r.order_items())
    return fx.product_items(products, items, r.sellers()).select(
        "product_id", "order_id", "seller_id", "price", "seller_city", "seller_state", "product_category_name")


PAY_PAIRS = "SELECT order_id, payment_type FROM r_order_payments"


@register("dedup_rows", with_ctes([], f"SELECT DISTINCT order_id, payment_type FROM ({PAY_PAIRS})",
                                  roles=["r_order_payments"]))
def q_dedup_rows(spark, sf_dir):
    return clean.dedup_rows(Roles(spark, sf_dir).order_payments(), ["order_id", "payment_type"])


@register("duplicate_count", with_ctes([], (
    f"SELECT CAST((SELECT count(*) FROM ({PAY_PAIRS})) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({PAY_PAIRS}))) AS BIGINT) AS duplicates"),
    roles=["r_order_payments"]))
def q_duplicate_count(spark, sf_dir):
    return profile.duplicate_count(Roles(spark, sf_dir).order_payments().select("order_id", "payment_type"))


M1_RAW = ("m1raw", "SELECT o.order_id, o.customer_unique_id, o.order_approved_at, o.order_delivered_customer_date, "
                   "r.review_id, r.review_score FROM o LEFT JOIN r_order_reviews r ON o.order_id = r.order_id")
NP_COLS = ["order_id", "customer_unique_id", "order_approved_at", "order_delivered_customer_date", "review_id", "review_score"]


@register("null_profile", with_ctes([O_CTE, M1_RAW], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM m1raw" for c in NP_COLS),
    roles=["r_orders", "r_customers", "r_order_reviews"]))
def q_null_profile(spark, sf_dir):
    r = Roles(spark, sf_dir)
    o = fx.orders_with_customers(r.orders(), r.customers())
    m = fx.with_reviews(o, r.order_reviews(), ["review_id", "order_id", "review_score"])
    return profile.null_profile(m.select(*NP_COLS))


@register("row_profile", fact_sql(
    "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT order_id) AS BIGINT) AS distinct_order_id, "
    "CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS distinct_customer_unique_id FROM m1"))
def q_row_profile(spark, sf_dir):
    return profile.row_profile(fact_parts(spark, sf_dir).base, ["order_id", "customer_unique_id"])


CP_COLS = ["customer_state", "payment_type", "product_category_name"]


@register("category_profile", fact_sql(
    "SELECT c.column_name, CAST(d.distinct_values AS BIGINT) AS distinct_values, CAST(c.rank AS INTEGER) AS rank, c.value, CAST(c.count AS BIGINT) AS count "
    "FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value ASC) AS rank FROM cnt) c "
    "JOIN (SELECT column_name, count(*) AS distinct_values FROM cnt GROUP BY column_name) d ON c.column_name = d.column_name WHERE rank <= 3",
    extra=[("lng", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM fact" for c in CP_COLS)),
           ("cnt", "SELECT column_name, value, count(*) AS count FROM lng WHERE value IS NOT NULL GROUP BY column_name, value")]))
def q_category_profile(spark, sf_dir):
    return profile.category_profile(fact_parts(spark, sf_dir).fact, CP_COLS, 3).select(
        "column_name", "distinct_values", "rank", "value", "count")
