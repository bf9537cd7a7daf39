"""Registered queries: dashboard figures, rates, histograms, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.operators import report as rp
from lapse.plans import fact as fx
from lapse.plans.fact_queries import fact_parts, fact_sql
from lapse.plans.memo import fingerprint, known, memo
from lapse.plans.registry import register
from lapse.session import materialize
from lapse.plans.rfm_queries import rfm_frames, rfm_sql

R6 = 6
MI_COLS = fx.MODEL_INPUT_COLUMNS


def app_model_input(spark, sf_dir, columns=None):
    """The app's analysis table: fact + RFM, model columns, no NULLs (G5),
    materialised once per input version.

    For a query that reads it once, ``columns`` names what is read: the same
    rows, from the stored table if there is one, else built with only these
    columns of the fact shuffled and nothing stored."""
    key = ("model_input", fingerprint(sf_dir))

    def build():
        parts, r = rfm_frames(spark, sf_dir, "app")
        return fx.model_input(parts.fact, r)
    if columns is not None:
        return (memo(spark, key, build) if known(spark, key) else build()).select(*columns)
    return memo(spark, key, lambda: materialize(build(), "model_input", codec="zstd"))


def mi_sql(final, extra=None):
    """Oracle over the app model input (CTE ``mi``)."""
    cols = ", ".join(f"f.{c}" if c != "RFM_Score" else "r.RFM_Score" for c in MI_COLS)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in MI_COLS)
    return rfm_sql(final, "app", [("mi0", f"SELECT {cols} FROM fact f LEFT JOIN rfm r ON f.customer_unique_id = r.customer_unique_id"),
                                  ("mi", f"SELECT * FROM mi0 WHERE {nn}")] + (extra or []))


@register("model_input", mi_sql("SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in ("payment_value", "price", "approval_delay") else c for c in MI_COLS) + " FROM mi"))
def q_model_input(spark, sf_dir):
    mi = app_model_input(spark, sf_dir)
    return mi.select(*[F.round(c, R6).alias(c) if c in ("payment_value", "price", "approval_delay") else c
                       for c in MI_COLS])


@register("headline", mi_sql("SELECT CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS customers, "
                             "round(avg(is_churned), 6) AS churn_rate, round(avg(RFM_Score), 6) AS mean_rfm_score FROM mi"))
def q_headline(spark, sf_dir):
    h = rp.headline(app_model_input(spark, sf_dir))
    return h.select("customers", F.round("churn_rate", R6).alias("churn_rate"),
                    F.round("mean_rfm_score", R6).alias("mean_rfm_score"))


@register("churn_by_state", mi_sql("SELECT customer_state, round(avg(is_churned), 6) AS churn_rate, CAST(count(*) AS BIGINT) AS n "
                                   "FROM mi GROUP BY customer_state"))
def q_churn_by_state(spark, sf_dir):
    c = rp.churn_by(app_model_input(spark, sf_dir, ["customer_state", "is_churned"]), ["customer_state"])
    return c.select("customer_state", F.round("churn_rate", R6).alias("churn_rate"), "n").orderBy(
        F.desc("churn_rate"), "customer_state")


@register("churn_by_state_customers", mi_sql(
    "SELECT customer_state, round(avg(is_churned), 6) AS churn_rate, CAST(count(*) AS BIGINT) AS n FROM "
    "(SELECT DISTINCT customer_state, customer_unique_id, is_churned FROM mi) GROUP BY customer_state"))
def q_churn_by_state_customers(spark, sf_dir):
    c = rp.churn_by(app_model_input(spark, sf_dir, ["customer_state", "customer_unique_id", "is_churned"]), ["customer_state"], unit="customer")
    return c.select("customer_state", F.round("churn_rate", R6).alias("churn_rate"), "n")


@register("churn_by_state_category", mi_sql(
    "SELECT customer_state, product_category_name, round(avg(is_churned), 6) AS churn_rate, CAST(count(*) AS BIGINT) AS n "
    "FROM mi GROUP BY customer_state, product_category_name"))
def q_churn_by_state_category(spark, sf_dir):
    """Heat-map data: the app groups its analysis table (nulls already
    dropped) by state and category."""
    dims = ["customer_state", "product_category_name"]
    c = rp.churn_by(app_model_input(spark, sf_dir, [*dims, "is_churned"]), dims)
    return c.select("customer_state", "product_category_name", F.round("churn_rate", R6).alias("churn_rate"), "n")


@register("count_by_state", mi_sql("SELECT customer_state, CAST(count(*) AS BIGINT) AS count FROM mi GROUP BY customer_state"))
def q_count_by_state(spark, sf_dir):
    return rp.count_by(app_model_input(spark, sf_dir, ["customer_state"]), "customer_state").orderBy(F.desc("count"), "customer_state")


@register("count_customers_by_state", mi_sql(
    "SELECT customer_state, CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS count FROM mi GROUP BY customer_state"))
def q_count_customers_by_state(spark, sf_dir):
    return rp.count_by(app_model_input(spark, sf_dir, ["customer_state", "customer_unique_id"]), "customer_state", unit="customer")


@register("top_states", mi_sql(
    "SELECT customer_state, round(churn_rate, 6) AS churn_rate FROM (SELECT customer_state, avg(is_churned) AS churn_rate "
    "FROM mi GROUP BY customer_state) ORDER BY churn_rate DESC, customer_state LIMIT 3"))
def q_top_states(spark, sf_dir):
    c = rp.churn_by(app_model_input(spark, sf_dir, ["customer_state", "is_churned"]), ["customer_state"])
    return rp.top_n(c, "churn_rate", 3, tie_breakers=["customer_state"]).select(
        "customer_state", F.round("churn_rate", R6).alias("churn_rate"))


@register("distinct_states", mi_sql("SELECT DISTINCT customer_state FROM mi"))
def q_distinct_states(spark, sf_dir):
    return rp.distinct_values(app_model_input(spark, sf_dir, ["customer_state"]), "customer_state")


@register("label_share", mi_sql("SELECT is_churned, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent "
                                "FROM mi GROUP BY is_churned"))
def q_label_share(spark, sf_dir):
    s = rp.value_share(app_model_input(spark, sf_dir), "is_churned")
    return s.withColumn("percent", F.round("percent", R6))


# Fixed parameters of the population filter example: a state list and a
# score range, as a dashboard user would pick them.
POP_STATES = ["NATION_1", "NATION_3", "NATION_7", "NATION_12", "NATION_20"]
POP_RANGE = (6, 12)


@register("filter_population", mi_sql(
    "SELECT customer_unique_id, customer_state, RFM_Score, is_churned FROM mi WHERE customer_state IN ("
    + ", ".join(f"'{s}'" for s in POP_STATES) + f") AND RFM_Score BETWEEN {POP_RANGE[0]} AND {POP_RANGE[1]}"))
def q_filter_population(spark, sf_dir):
    f = rp.filter_population(app_model_input(spark, sf_dir), POP_STATES, POP_RANGE)
    return f.select("customer_unique_id", "customer_state", "RFM_Score", "is_churned")


RECORD_ORDER = ["order_status", "payment_type", "payment_installments", "payment_value", "price",
                "product_category_name", "seller_city", "review_score", "approval_delay"]


@register("customer_record", mi_sql(
    "SELECT customer_unique_id, customer_state, RFM_Score, round(payment_value, 6) AS payment_value, review_score, is_churned "
    "FROM mi WHERE customer_unique_id = (SELECT min(customer_unique_id) FROM mi) ORDER BY " + ", ".join(RECORD_ORDER) + " LIMIT 1"))
def q_customer_record(spark, sf_dir):
    mi = app_model_input(spark, sf_dir)
    first = mi.agg(F.min("customer_unique_id").alias("_id"))
    rec = rp.customer_record(mi, first, RECORD_ORDER)
    return rec.select("customer_unique_id", "customer_state", "RFM_Score",
                      F.round("payment_value", R6).alias("payment_value"), "review_score", "is_churned")


@register("on_time_share", fact_sql("SELECT round(count_if(delivery_delay <= 0) * 100.0 / count(*), 6) AS on_time_pct, "
                                    "CAST(count(*) AS BIGINT) AS rows FROM fact"))
def q_on_time_share(spark, sf_dir):
    s = rp.on_time_share(fact_parts(spark, sf_dir).fact)
    return s.select(F.round("on_time_pct", R6).alias("on_time_pct"), "rows")


@register("value_range", fact_sql("SELECT min(delivery_time_to_customer_days) AS min, max(delivery_time_to_customer_days) AS max FROM fact"))
def q_value_range(spark, sf_dir):
    return rp.value_range(fact_parts(spark, sf_dir).fact, "delivery_time_to_customer_days")


def _hist_sql(src_cte, c, bins, by=None):
    keys = f"{by}, " if by else ""
    return (f"SELECT {keys}bin, round(lo + bin * (hi - lo) / {bins}, 6) AS lower, round(lo + (bin + 1) * (hi - lo) / {bins}, 6) AS upper, "
            f"CAST(count(*) AS BIGINT) AS count FROM (SELECT {keys}lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE "
            f"least(floor((CAST({c} AS DOUBLE) - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin "
            f"FROM {src_cte}, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {src_cte} WHERE {c} IS NOT NULL) e "
            f"WHERE {c} IS NOT NULL) GROUP BY {keys}bin, lo, hi")


def _hist_out(h, by=None):
    return h.select(*([by] if by else []), "bin", F.round("lower", R6).alias("lower"),
                    F.round("upper", R6).alias("upper"), "count")


@register("histogram_score", mi_sql(_hist_sql("mi", "RFM_Score", 20, "is_churned")))
def q_histogram_score(spark, sf_dir):
    return _hist_out(rp.histogram(app_model_input(spark, sf_dir), "RFM_Score", 20, by="is_churned"), "is_churned")


@register("histogram_delivery", fact_sql(_hist_sql("fact", "delivery_time_to_customer_days", 30)))
def q_histogram_delivery(spark, sf_dir):
    return _hist_out(rp.histogram(fact_parts(spark, sf_dir).fact, "delivery_time_to_customer_days", 30))


DENSITY_POINTS = 50


@register("density", fact_sql(
    f"SELECT CAST(g.i AS INTEGER) AS point, round(s.lo + g.i * (s.hi - s.lo) / {DENSITY_POINTS - 1}, 6) AS x, "
    f"round(sum(v.w * exp(-0.5 * pow((s.lo + g.i * (s.hi - s.lo) / {DENSITY_POINTS - 1} - v.x) / (s.sd * pow(s.n, -0.2)), 2)) / sqrt(2 * pi())) "
    f"/ (s.n * s.sd * pow(s.n, -0.2)), 9) AS density "
    f"FROM (SELECT CAST(delivery_time_to_customer_days AS DOUBLE) AS x, count(*) AS w FROM fact WHERE delivery_time_to_customer_days IS NOT NULL GROUP BY 1) v, "
    f"(SELECT min(delivery_time_to_customer_days) AS lo, max(delivery_time_to_customer_days) AS hi, stddev_samp(delivery_time_to_customer_days) AS sd, "
    f"CAST(count(delivery_time_to_customer_days) AS DOUBLE) AS n FROM fact) s, range({DENSITY_POINTS}) g(i) GROUP BY g.i, s.lo, s.hi, s.sd, s.n"))
def q_density(spark, sf_dir):
    d = rp.density(fact_parts(spark, sf_dir).fact, "delivery_time_to_customer_days", DENSITY_POINTS)
    return d.select("point", F.round("x", R6).alias("x"), F.round("density", 9).alias("density"))
