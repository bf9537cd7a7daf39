"""Registered queries that chain operators as the programs do, and the same operators at other bucket counts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from lapse.operators import clean
from lapse.operators import geo as gx
from lapse.operators import lifecycle as lc
from lapse.operators import metrics as mt
from lapse.operators import ml
from lapse.operators import report as rp
from lapse.operators import rfm as rf
from lapse.operators import stats as st
from lapse.operators.ordered import quantiles
from lapse.plans.fact_queries import fact_parts
from lapse.plans.geo_queries import GEO_CTES, GEO_ROLES, REGION_CITY, REGION_STATE, loaded
from lapse.plans.lifecycle_queries import SRC_ORDERS, _label_ctes, orders_input
from lapse.plans.ml_queries import fitted, scored_input
from lapse.plans.registry import ORACLE, register, with_ctes
from lapse.plans.report_queries import POP_RANGE, POP_STATES, app_model_input, mi_sql
from lapse.plans.rfm_queries import rfm_frames, rfm_measures
from lapse.plans.stats_queries import CATEGORICAL, notebook_frames
from lapse.session import checkpoint_dir
from lapse.sources.roles import Roles
from lapse.sources.tables import parse_ts, read_table

R6 = 6

# --- order rhythm over the whole orders table, dealt to the default number of tasks and to one -----

GAPS_SQL = with_ctes([("src", SRC_ORDERS)], (
    "SELECT k AS customer_unique_id, o AS order_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY k ORDER BY ts, o))) / 86400000000.0) AS BIGINT) AS gap_days FROM src"))
HIST_SQL = with_ctes(_label_ctes(SRC_ORDERS), (
    "SELECT k AS customer_unique_id, CAST(gap AS BIGINT) AS gap_days, CAST(count(*) AS BIGINT) AS n FROM pts WHERE gap IS NOT NULL GROUP BY k, gap"))
MEDIAN_SQL = with_ctes(_label_ctes(SRC_ORDERS), "SELECT k AS customer_unique_id, med AS median_interval_days FROM feat WHERE med IS NOT NULL")

for _name, _ranges in (("all_orders", None), ("one_bucket", 1)):
    @register(f"order_gaps_{_name}", GAPS_SQL)
    def q_order_gaps(spark, sf_dir, ranges=_ranges):
        return lc.order_gaps(orders_input(spark, sf_dir), ranges=ranges).select("customer_unique_id", "order_id", "gap_days")

    @register(f"gap_histogram_{_name}", HIST_SQL)
    def q_gap_histogram(spark, sf_dir, ranges=_ranges):
        return lc.gap_histogram(orders_input(spark, sf_dir), ranges=ranges)

    @register(f"customer_intervals_{_name}", MEDIAN_SQL)
    def q_intervals(spark, sf_dir, ranges=_ranges):
        return lc.customer_intervals(orders_input(spark, sf_dir), ranges=ranges)

# --- global order at 1 and 16 buckets ---------------------------------------------

for _n in (1, 16):
    @register(f"rfm_quantiles_{_n}_buckets", ORACLE["rfm_quantiles"])
    def q_rfm_quantiles(spark, sf_dir, n=_n):
        q = quantiles(rf.rfm_base(fact_parts(spark, sf_dir).fact), rf.MEASURES, rf.SCORE_PROBS, buckets=n)
        return q.select("column_name", "p", F.round("value", R6).alias("value"))

    @register(f"label_encode_{_n}_buckets", ORACLE["label_encode"])
    def q_label_encode(spark, sf_dir, n=_n):
        enc = st.label_encode(notebook_frames(spark, sf_dir)[2], CATEGORICAL, buckets=n)
        return enc.select("order_id", "review_id", "product_id", "seller_id", "payment_type", "payment_installments",
                          F.round("payment_value", R6).alias("payment_value"), *[f"{c}_code" for c in CATEGORICAL])

    @register(f"roc_auc_{_n}_buckets", ORACLE["roc_auc"])
    def q_roc_auc(spark, sf_dir, n=_n):
        return mt.roc_auc(scored_input(spark, sf_dir), buckets=n).select(F.round("roc_auc", R6).alias("roc_auc"))

# --- map: the selected region as one chain --------------------------------------------

_SEL = f"geolocation_state = '{REGION_STATE}' AND lower(geolocation_city) = lower('{REGION_CITY}')"
_SEL_CTES = [
    ("gsel", f"SELECT * FROM geo WHERE {_SEL}"),
    ("cut", "SELECT quantile_cont(x, 0.001) AS x0, quantile_cont(x, 0.999) AS x1, quantile_cont(y, 0.001) AS y0, quantile_cont(y, 0.999) AS y1 FROM gsel"),
    ("pts", "SELECT gsel.* FROM gsel, cut WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"),
    ("ssel", f"SELECT * FROM sales WHERE customer_state = '{REGION_STATE}' AND lower(customer_city) = lower('{REGION_CITY}')"),
    ("ord", "SELECT order_id, sum(price) AS price, sum(freight_value) AS freight, min(customer_zip_code_prefix_3_digits) AS k FROM ssel GROUP BY order_id"),
    ("prefix", "SELECT s.k, revenue, ticket, ratio FROM (SELECT customer_zip_code_prefix_3_digits AS k, sum(price) / 1000 AS revenue FROM ssel GROUP BY 1) s "
               "LEFT JOIN (SELECT k, avg(price) AS ticket FROM ord GROUP BY k) t ON s.k = t.k "
               "LEFT JOIN (SELECT k, avg(freight / price) AS ratio FROM ord WHERE price > 0 GROUP BY k) f ON s.k = f.k WHERE s.k IS NOT NULL"),
]


@register("region_headline", with_ctes([c for c in GEO_CTES if c[0] in ("g0", "geo", "sales")] + _SEL_CTES, (
    "SELECT CAST(count(*) AS BIGINT) AS points, round(sum(coalesce(revenue, 0)), 4) AS revenue_total, "
    "round(avg(ticket), 4) AS mean_ticket, round(avg(ratio), 6) AS mean_freight_ratio "
    "FROM pts LEFT JOIN prefix ON geolocation_zip_code_prefix_3_digits = k"), roles=GEO_ROLES))
def q_region_headline(spark, sf_dir):
    """State and city picked, outliers clipped among the picked points, then the three metrics."""
    geo, sales = gx.filter_region(*loaded(spark, sf_dir), REGION_STATE, REGION_CITY)
    geo = gx.clip_outliers(geo)
    h = gx.geo_headline_of(gx.geo_metrics(geo, sales))
    return h.select("points", F.round("revenue_total", 4).alias("revenue_total"), F.round("mean_ticket", 4).alias("mean_ticket"),
                    F.round("mean_freight_ratio", R6).alias("mean_freight_ratio"))

# --- dashboard: population filter before the figures -------------------------------------

_POP = ("pop", "SELECT * FROM mi WHERE customer_state IN (" + ", ".join(f"'{s}'" for s in POP_STATES)
        + f") AND RFM_Score BETWEEN {POP_RANGE[0]} AND {POP_RANGE[1]}")
_CORR = [("payment_value", "price"), ("payment_value", "RFM_Score"), ("RFM_Score", "is_churned")]


@register("filtered_dashboard", mi_sql(
    "SELECT 'customers' AS figure, '' AS item, CAST(count(DISTINCT customer_unique_id) AS DOUBLE) AS value FROM pop "
    "UNION ALL SELECT 'churn_rate', '', round(avg(is_churned), 6) FROM pop "
    "UNION ALL SELECT 'mean_rfm_score', '', round(avg(RFM_Score), 6) FROM pop "
    "UNION ALL SELECT 'churn_rate_by_state', customer_state, round(avg(is_churned), 6) FROM pop GROUP BY customer_state "
    + " ".join(f"UNION ALL SELECT 'corr', '{a} {b}', round(corr({a}, {b}), 6) FROM pop" for a, b in _CORR), [_POP]))
def q_filtered_dashboard(spark, sf_dir):
    """Headline, rates and correlations of the filtered population."""
    pop = rp.filter_population(app_model_input(spark, sf_dir), POP_STATES, POP_RANGE)
    line = lambda df, figure, item, value: df.select(F.lit(figure).alias("figure"), item.alias("item"), value.cast("double").alias("value"))
    head = rp.headline(pop)
    out = line(head, "customers", F.lit(""), F.col("customers"))
    for c in ("churn_rate", "mean_rfm_score"):
        out = out.unionByName(line(head, c, F.lit(""), F.round(c, R6)))
    out = out.unionByName(line(rp.churn_by(pop, ["customer_state"]), "churn_rate_by_state", F.col("customer_state"), F.round("churn_rate", R6)))
    names = sorted({c for pair in _CORR for c in pair})
    corr = st.corr_matrix(pop, names)
    wanted = F.concat_ws(" ", "col_a", "col_b")
    return out.unionByName(line(corr.where(wanted.isin([f"{a} {b}" for a, b in _CORR])), "corr", wanted, F.round("corr", R6)))

# --- ingest: header, index column, zip text, bad dates ------------------------------------


def _csv(spark, df, name):
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("header", True).csv(path)
    return path


@register("csv_geolocation", with_ctes([], (
    "SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, geolocation_city, geolocation_state FROM r_geolocation"), roles=["r_geolocation"]))
def q_csv_geolocation(spark, sf_dir):
    """Written as CSV with a leading index column and its columns in another order, read back by name."""
    g = Roles(spark, sf_dir).geolocation()
    shuffled = g.select(F.lit(0).alias("Unnamed: 0"), "geolocation_state", "geolocation_lng", "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_city")
    return read_table(spark, _csv(spark, shuffled, "geolocation"), "geolocation")


@register("csv_reviews", with_ctes([], (
    "SELECT review_id, order_id, CAST(review_score AS BIGINT) AS review_score, "
    "CASE WHEN review_id % 10 = 3 THEN NULL ELSE CAST(epoch(review_creation_date) AS BIGINT) END AS created FROM r_order_reviews"), roles=["r_order_reviews"]))
def q_csv_reviews(spark, sf_dir):
    """Reviews from CSV without an index column; every tenth date is no date and becomes NULL."""
    r = Roles(spark, sf_dir).order_reviews()
    stamp = F.date_format(F.col("review_creation_date").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    text = r.select("review_score", "review_id", "order_id", F.when(F.col("review_id") % 10 == 3, "no date").otherwise(stamp).alias("review_creation_date"))
    back = parse_ts(read_table(spark, _csv(spark, text, "reviews"), "order_reviews"), ["review_creation_date"], "coerce")
    return back.select(F.col("review_id").cast("bigint").alias("review_id"), F.col("order_id").cast("bigint").alias("order_id"),
                       "review_score", F.unix_seconds("review_creation_date").alias("created"))


@register("null_rows", with_ctes([], "SELECT product_id, product_weight_g FROM r_products WHERE product_category_name IS NULL", roles=["r_products"]))
def q_null_rows(spark, sf_dir):
    return clean.null_rows(Roles(spark, sf_dir).products(), "product_category_name").select("product_id", "product_weight_g")

# --- skewness with the fitted lambda; importances of every tree model ---------------------


@register("skewness_report_fitted")
def q_skewness_report_fitted(spark, sf_dir):
    """All three measures, Box-Cox at the maximum-likelihood lambda (found by search: no SQL form)."""
    base = rfm_measures(spark, sf_dir)
    return st.skewness_report(base.withColumns({c: F.col(c).cast("double") for c in rf.MEASURES}), rf.MEASURES)


for _kind, _features in (("forest", ml.NUMERIC_FEATURES), ("boosted", ml.NUMERIC_FEATURES_APP)):
    @register(f"feature_importance_{_kind}")
    def q_importance(spark, sf_dir, kind=_kind, features=_features):
        return ml.feature_importance(fitted(spark, sf_dir, kind, features), 15)

# --- the dashboard page of a filtered population ------------------------------------------

_BINS = 12
_PAGE = [_POP,
         ("ext", "SELECT min(payment_value) AS lo, max(payment_value) AS hi FROM pop"),
         ("seg", "SELECT DISTINCT pop.customer_unique_id AS c, Segment, Score FROM pop JOIN rfm ON pop.customer_unique_id = rfm.customer_unique_id")]


@register("dashboard_page", mi_sql(
    f"SELECT 'histogram' AS figure, concat(is_churned, ' ', b) AS item, CAST(count(*) AS DOUBLE) AS value FROM (SELECT is_churned, CAST(least(floor((payment_value - lo) / ((hi - lo) / {_BINS})), {_BINS - 1}) AS INTEGER) AS b "
    "FROM pop, ext) GROUP BY is_churned, b "
    "UNION ALL SELECT 'churn_rate_by_category', product_category_name, round(avg(is_churned), 6) FROM pop GROUP BY product_category_name "
    "UNION ALL SELECT 'rows_by_state', customer_state, count(*) FROM pop GROUP BY customer_state "
    "UNION ALL SELECT 'segment_percent', Segment, round(count(*) * 100.0 / (SELECT count(*) FROM seg), 6) FROM seg GROUP BY Segment "
    "UNION ALL SELECT 'tier_percent', Score, round(count(*) * 100.0 / (SELECT count(*) FROM seg), 6) FROM seg GROUP BY Score", _PAGE))
def q_dashboard_page(spark, sf_dir):
    """Histogram by label, rates by category, rows by state, and the segment and tier shares of the customers that pass the filter."""
    pop = rp.filter_population(app_model_input(spark, sf_dir), POP_STATES, POP_RANGE)
    rfm = rfm_frames(spark, sf_dir, "app")[1].select("customer_unique_id", "Segment", "Score")
    people = pop.select("customer_unique_id").distinct().join(rfm, "customer_unique_id")
    line = lambda df, figure, item, value: df.select(F.lit(figure).alias("figure"), item.alias("item"), F.round(F.col(value).cast("double"), R6).alias("value"))
    out = line(rp.histogram(pop, "payment_value", _BINS, by="is_churned"), "histogram", F.concat_ws(" ", "is_churned", "bin"), "count")
    out = out.unionByName(line(rp.churn_by(pop, ["product_category_name"]), "churn_rate_by_category", F.col("product_category_name"), "churn_rate"))
    out = out.unionByName(line(rp.count_by(pop, "customer_state"), "rows_by_state", F.col("customer_state"), "count"))
    for figure, c in (("segment_percent", "Segment"), ("tier_percent", "Score")):
        out = out.unionByName(line(rp.value_share(people, c), figure, F.col(c), "percent"))
    return out
