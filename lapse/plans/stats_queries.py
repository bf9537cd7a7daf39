"""Registered queries: transforms, Box-Cox, z-scores, correlation, codes, chi-square."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.functions.transforms import boxcox, boxcox1p
from lapse.operators import rfm as rf
from lapse.operators import stats as st
from lapse.plans import fact as fx
from lapse.plans.registry import register
from lapse.plans.rfm_queries import rfm_frames, rfm_measures, rfm_sql

R6 = 6
NUMERIC = ["payment_value", "review_score", "price", "product_weight_g", "approval_delay"]
CATEGORICAL = ["customer_city", "customer_state", "order_status", "payment_type", "payment_installments",
               "seller_city", "seller_state", "product_category_name"]
# Fixed parameters of the fixed-λ examples and the likelihood grid.
FIXED_LAMBDAS = {"MonetaryValue": 0.5, "Recency": -0.5}
LLF_GRID = [-1.0, -0.5, 0.0, 0.5, 1.0]


def notebook_frames(spark, sf_dir):
    """(fact, rfm, merge6): the notebook's fact with RFM columns attached."""
    parts, r = rfm_frames(spark, sf_dir, "notebook")
    m6 = fx.model_input(parts.fact, r, columns=parts.fact.columns + ["Frequency", "MonetaryValue", "Recency",
                                                                        "R", "F", "M", "RFM_Score", "RFM_Segment"],
                        drop_null=False)
    return parts.fact, r, m6


M6_CTE = ("m6", "SELECT fact.*, rfm.Frequency, rfm.MonetaryValue, rfm.Recency, rfm.R, rfm.F, rfm.M, rfm.RFM_Score, rfm.RFM_Segment "
                "FROM fact LEFT JOIN rfm ON fact.customer_unique_id = rfm.customer_unique_id")


def nb_sql(final, extra=None):
    return rfm_sql(final, "notebook", [M6_CTE] + (extra or []))


@register("skew_transforms", nb_sql("SELECT customer_unique_id, " + ", ".join(
    f"round(ln({c} + 0.1), 6) AS {c}_log, round(sqrt({c}), 6) AS {c}_sqrt" for c in rf.MEASURES) + " FROM rfm0"))
def q_skew_transforms(spark, sf_dir):
    base = rfm_measures(spark, sf_dir)
    t = st.skew_transforms(base, rf.MEASURES)
    return t.select("customer_unique_id", *[F.round(f"{c}_{k}", R6).alias(f"{c}_{k}")
                                            for c in rf.MEASURES for k in ("log", "sqrt")])


@register("boxcox_fixed", nb_sql(
    "SELECT customer_unique_id, round((pow(MonetaryValue, 0.5) - 1) / 0.5, 6) AS monetary_bc, "
    "round((pow(Recency + 1, -0.5) - 1) / -0.5, 6) AS recency_bc1p FROM rfm0"))
def q_boxcox_fixed(spark, sf_dir):
    base = rfm_measures(spark, sf_dir)
    return base.select("customer_unique_id",
                       F.round(boxcox("MonetaryValue", FIXED_LAMBDAS["MonetaryValue"]), R6).alias("monetary_bc"),
                       F.round(boxcox1p("Recency", FIXED_LAMBDAS["Recency"]), R6).alias("recency_bc1p"))


def _llf_sql(lam):
    if lam == 0:
        return "(-1.0) * sum(ln(MonetaryValue)) - count(*) / 2.0 * ln(var_pop(ln(MonetaryValue)))"
    return f"({lam} - 1.0) * sum(ln(MonetaryValue)) - count(*) / 2.0 * ln(var_pop(pow(MonetaryValue, {lam}) / {lam}))"


@register("boxcox_llf_grid", nb_sql(" UNION ALL ".join(
    f"SELECT CAST({lam} AS DOUBLE) AS lambda, round({_llf_sql(lam)}, 4) AS llf FROM rfm0" for lam in LLF_GRID)))
def q_boxcox_llf_grid(spark, sf_dir):
    base = rfm_measures(spark, sf_dir)
    g = st.boxcox_llf_grid(base, "MonetaryValue", LLF_GRID)
    return g.select("lambda", F.round("llf", 4).alias("llf"))


@register("boxcox_lambda")
def q_boxcox_lambda(spark, sf_dir):
    """λ by maximum likelihood and by probability-plot correlation, as the
    clustering preset uses them (rows-only check; tests compare against a
    brute-force search)."""
    base = rfm_measures(spark, sf_dir)
    lam_mle = st.boxcox_lambda(base, "MonetaryValue")
    lam_ppcc = st.boxcox_normmax(base, "MonetaryValue", offset=1.0)
    return spark.createDataFrame([("MonetaryValue", "mle", lam_mle), ("MonetaryValue+1", "pearsonr", lam_ppcc)],
                                 "column_name string, method string, lambda double")


@register("zscore", nb_sql("SELECT customer_unique_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}_z" for c in rf.MEASURES) + " FROM rfm0"))
def q_zscore(spark, sf_dir):
    base = rfm_measures(spark, sf_dir)
    z = st.zscore(base, rf.MEASURES)
    return z.select("customer_unique_id", *[F.round(f"{c}_z", R6).alias(f"{c}_z") for c in rf.MEASURES])


def _skew_sql(expr, c, t):
    m = f"(SELECT {expr} AS v FROM rfm0 WHERE {expr} IS NOT NULL)"
    return (f"SELECT '{c}' AS column_name, '{t}' AS transform, CAST(count(*) AS BIGINT) AS n, "
            f"round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5), 6) AS skewness, "
            f"round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5) * sqrt(count(*) * (count(*) - 1.0)) / (count(*) - 2.0), 6) AS skewness_adj "
            f"FROM {m}, (SELECT avg(v) AS mu FROM {m}) a GROUP BY mu")


SKEW_VARIANTS = {"raw": "{c}", "log": "ln({c} + 0.1)", "sqrt": "sqrt({c})"}


@register("skewness_report", nb_sql(" UNION ALL ".join(
    [_skew_sql(e.format(c=c), c, t) for c in rf.MEASURES for t, e in SKEW_VARIANTS.items()]
    + [_skew_sql("(pow(MonetaryValue, 0.5) - 1) / 0.5", "MonetaryValue", "boxcox")])))
def q_skewness_report(spark, sf_dir):
    base = rfm_measures(spark, sf_dir).withColumn("Recency", F.col("Recency").cast("double"))
    r = st.skewness_report(base, rf.MEASURES, lambdas={"Recency": None, "Frequency": None, "MonetaryValue": 0.5})
    return r.select("column_name", "transform", "n", F.round("skewness", R6).alias("skewness"),
                    F.round("skewness_adj", R6).alias("skewness_adj"))


CORR_COLS = ["payment_value", "review_score", "RFM_Score", "is_churned"]


@register("corr_matrix", nb_sql(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({'max(1.0)' if a == b else f'corr({a}, {b})'}, 6) AS corr FROM m6"
    for a in CORR_COLS for b in CORR_COLS)))
def q_corr_matrix(spark, sf_dir):
    m = st.corr_matrix(notebook_frames(spark, sf_dir)[2], CORR_COLS)
    return m.select("col_a", "col_b", F.round("corr", R6).alias("corr"))


@register("corr_target", nb_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(corr({c}, is_churned), 6) AS corr FROM m6" for c in NUMERIC + ["is_churned"])))
def q_corr_target(spark, sf_dir):
    m = st.corr_with(notebook_frames(spark, sf_dir)[2], NUMERIC, "is_churned")
    return m.select("column_name", F.round("corr", R6).alias("corr"))


@register("corr_pair", nb_sql("SELECT round(corr(payment_value, MonetaryValue), 6) AS corr FROM m6"))
def q_corr_pair(spark, sf_dir):
    m6 = notebook_frames(spark, sf_dir)[2]
    return m6.agg(F.round(F.corr("payment_value", "MonetaryValue"), R6).alias("corr"))


def _codes_sql():
    cols = ", ".join(f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'nan')) - 1 AS BIGINT) AS {c}_code"
                     for c in CATEGORICAL)
    return ("enc", f"SELECT order_id, review_id, product_id, seller_id, payment_type AS pt, payment_installments AS pi, "
                   f"round(payment_value, 6) AS pv, is_churned, {cols} FROM m6")


@register("label_encode", nb_sql("SELECT order_id, review_id, product_id, seller_id, pt AS payment_type, pi AS payment_installments, "
                                 "pv AS payment_value, " + ", ".join(f"{c}_code" for c in CATEGORICAL) + " FROM enc",
                                 [_codes_sql()]))
def q_label_encode(spark, sf_dir):
    m6 = notebook_frames(spark, sf_dir)[2]
    enc = st.label_encode(m6, CATEGORICAL)
    return enc.select("order_id", "review_id", "product_id", "seller_id", "payment_type", "payment_installments",
                      F.round("payment_value", R6).alias("payment_value"), *[f"{c}_code" for c in CATEGORICAL])


def chi2_frame(spark, sf_dir):
    m6 = notebook_frames(spark, sf_dir)[2]
    enc = st.label_encode(m6, CATEGORICAL)
    return st.chi2_scores(enc, [f"{c}_code" for c in CATEGORICAL], "is_churned")


@register("chi2_scores", nb_sql(" UNION ALL ".join(
    f"SELECT '{c}_code' AS feature, round(sum(pow(obs - ex, 2) / ex), 6) AS chi2 FROM (SELECT is_churned, sum({c}_code) AS obs, "
    f"count(*) * 1.0 / sum(count(*)) OVER () * sum(sum({c}_code)) OVER () AS ex FROM enc WHERE is_churned IS NOT NULL GROUP BY is_churned)"
    for c in CATEGORICAL), [_codes_sql()]))
def q_chi2_scores(spark, sf_dir):
    return chi2_frame(spark, sf_dir).select("feature", F.round("chi2", R6).alias("chi2"))


# erfc(x) = 1 - 2 / sqrt(pi) exp(-x^2) sum 2^n x^(2n+1) / (2n+1)!!, all terms positive; below 1e-9 beyond x = 6
_ERFC = ("CASE WHEN x > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 250), lambda n: "
         "exp(-x * x + 2 * n * ln(2) + (2 * n + 1) * ln(x) + lgamma(n + 1) - lgamma(2 * n + 2)))) END")


@register("chi2_pvalues", nb_sql(" UNION ALL ".join(
    f"SELECT '{c}_code' AS feature, round(chi2, 6) AS chi2, round({_ERFC}, 6) AS p_value FROM (SELECT chi2, sqrt(chi2 / 2) AS x FROM (SELECT sum(pow(obs - ex, 2) / ex) AS chi2 "
    f"FROM (SELECT is_churned, sum({c}_code) AS obs, count(*) * 1.0 / sum(count(*)) OVER () * sum(sum({c}_code)) OVER () AS ex FROM enc WHERE is_churned IS NOT NULL GROUP BY is_churned)))"
    for c in CATEGORICAL), [_codes_sql()]))
def q_chi2_pvalues(spark, sf_dir):
    """Statistic with its p-value."""
    return chi2_frame(spark, sf_dir).select("feature", F.round("chi2", R6).alias("chi2"), F.round("p_value", R6).alias("p_value"))
