"""Registered queries: RFM measures, scores, segments, tiers and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.functions.rfm import SCORE_PROBS
from lapse.operators import lifecycle as lc
from lapse.operators import rfm as rf
from lapse.plans.fact_queries import fact_parts, fact_sql
from lapse.plans.memo import fingerprint, memo
from lapse.plans.registry import register
from lapse.session import materialize

R6 = 6


def _measured(spark, sf_dir, preset, parts):
    def build():
        if preset == "notebook":
            b = rf.rfm_base(parts.fact)
        else:
            b = rf.rfm_base(parts.fact, "elapsed_purchase", analysis_date=lc.analysis_date(parts.base))
        return materialize(b, "rfm_base")
    return memo(spark, ("rfm_base", preset, fingerprint(sf_dir)), build)


def rfm_frames(spark, sf_dir, preset="notebook"):
    """(parts, rfm) for a preset: notebook = calendar recency on approval
    dates; app = elapsed days from the order base's analysis date. The
    measures and the RFM table are materialised once per input version."""
    parts = fact_parts(spark, sf_dir, preset)

    def build():
        return materialize(rf.rfm(parts.fact, base=_measured(spark, sf_dir, preset, parts)), f"rfm_{preset}")
    return parts, memo(spark, ("rfm", preset, fingerprint(sf_dir)), build)


def rfm_measures(spark, sf_dir, preset="notebook"):
    """The stored Recency, Frequency and MonetaryValue that the RFM table of
    :func:`rfm_frames` is made of, for queries that read them many times."""
    return _measured(spark, sf_dir, preset, rfm_frames(spark, sf_dir, preset)[0])


def _score_case(x, best_first):
    low_to_high = f"WHEN {x} <= {x}_q0 THEN {{}} WHEN {x} <= {x}_q1 THEN {{}} WHEN {x} <= {x}_q2 THEN {{}} WHEN {x} <= {x}_q3 THEN {{}} ELSE {{}}"
    return "CASE " + low_to_high.format(*((5, 4, 3, 2, 1) if best_first else (1, 2, 3, 4, 5))) + " END"


# Written out by hand, not from the operator's rule tables, so that the two can disagree.
SEGMENT_SQL = """CASE
  WHEN R <= 2 AND F <= 2 THEN 'Спящие'
  WHEN R <= 2 AND F <= 4 THEN 'В зоне риска'
  WHEN R <= 2 THEN 'Нельзя потерять'
  WHEN R = 3 AND F <= 2 THEN 'На грани ухода'
  WHEN R = 3 AND F = 3 THEN 'Требуют внимания'
  WHEN R <= 4 AND F >= 4 THEN 'Лояльные клиенты'
  WHEN R = 4 AND F = 1 THEN 'Перспективные'
  WHEN R = 5 AND F = 1 THEN 'Новые клиенты'
  WHEN F <= 3 THEN 'Potential loyalists'
  ELSE 'Чемпионы' END"""
TIER_SQL = """CASE WHEN RFM_Score >= 11 THEN 'Платина' WHEN RFM_Score = 10 THEN 'Золото' WHEN RFM_Score >= 8 THEN 'Серебро'
  WHEN RFM_Score >= 6 THEN 'Бронза' ELSE 'Стандарт' END"""


def rfm_ctes(preset="notebook"):
    if preset == "notebook":
        base = [
            ("rb", "SELECT customer_unique_id, max(order_approved_at) AS last, count(DISTINCT order_id) AS Frequency, "
                   "sum(payment_value) AS MonetaryValue FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY 1"),
            ("rref", "SELECT max(order_approved_at) AS ref FROM fact"),
            ("rfm0", "SELECT customer_unique_id, CAST(date_diff('day', CAST(last AS DATE), CAST(ref AS DATE)) AS BIGINT) AS Recency, "
                     "CAST(Frequency AS BIGINT) AS Frequency, MonetaryValue FROM rb, rref"),
        ]
    else:
        base = [
            ("rb", "SELECT customer_unique_id, max(order_purchase_timestamp) AS last, count(DISTINCT order_id) AS Frequency, "
                   "sum(payment_value) AS MonetaryValue FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY 1"),
            ("rref", "SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY AS ref FROM m1"),
            ("rfm0", "SELECT customer_unique_id, CAST(floor((epoch_us(ref) - epoch_us(last)) / 86400000000.0) AS BIGINT) AS Recency, "
                     "CAST(Frequency AS BIGINT) AS Frequency, MonetaryValue FROM rb, rref"),
        ]
    qs = ", ".join(f"quantile_cont({c}, {p}) AS {c}_q{i}"
                   for c in ("Recency", "Frequency", "MonetaryValue") for i, p in enumerate(SCORE_PROBS))
    return base + [
        ("rq", f"SELECT {qs} FROM rfm0"),
        ("rs", "SELECT rfm0.*, "
               f"{_score_case('Recency', True)} AS R, {_score_case('Frequency', False)} AS F, "
               f"{_score_case('MonetaryValue', False)} AS M FROM rfm0, rq"),
        ("rfm1", "SELECT *, CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS RFM_Segment, R + F + M AS RFM_Score FROM rs"),
        ("rfm", f"SELECT *, {SEGMENT_SQL} AS Segment, {TIER_SQL} AS Score FROM rfm1"),
    ]


def rfm_sql(final, preset="notebook", extra=None):
    return fact_sql(final, preset, rfm_ctes(preset) + (extra or []))


def _measures(df):
    return df.select("customer_unique_id", "Recency", "Frequency",
                     F.round("MonetaryValue", R6).alias("MonetaryValue"))


@register("rfm_calendar", rfm_sql("SELECT customer_unique_id, Recency, Frequency, round(MonetaryValue, 6) AS MonetaryValue FROM rfm0"))
def q_rfm_calendar(spark, sf_dir):
    return _measures(rf.rfm_base(fact_parts(spark, sf_dir).fact))


@register("rfm_base", rfm_sql("SELECT customer_unique_id, Recency, Frequency, round(MonetaryValue, 6) AS MonetaryValue FROM rfm0", "app"))
def q_rfm_base(spark, sf_dir):
    parts = fact_parts(spark, sf_dir, "app")
    return _measures(rf.rfm_base(parts.fact, "elapsed_purchase", analysis_date=lc.analysis_date(parts.base)))


@register("rfm_base_payment_grain", fact_sql(
    "SELECT customer_unique_id, round(sum(payment_value), 6) AS MonetaryValue FROM "
    "(SELECT DISTINCT customer_unique_id, order_id, payment_type, payment_installments, payment_value FROM fact) GROUP BY 1"))
def q_rfm_payment_grain(spark, sf_dir):
    r = rf.rfm_base(fact_parts(spark, sf_dir).fact, grain="payment")
    return r.select("customer_unique_id", F.round("MonetaryValue", R6).alias("MonetaryValue"))


@register("rfm_quantiles", rfm_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS p, round({c}_q{i}, 6) AS value FROM rq"
    for c in ("Recency", "Frequency", "MonetaryValue") for i, p in enumerate(SCORE_PROBS))))
def q_rfm_quantiles(spark, sf_dir):
    from lapse.operators.ordered import quantiles
    base = rf.rfm_base(fact_parts(spark, sf_dir).fact)
    q = quantiles(base, rf.MEASURES, SCORE_PROBS)
    return q.select("column_name", "p", F.round("value", R6).alias("value"))


@register("rfm_scores", rfm_sql("SELECT customer_unique_id, R, F, M, RFM_Segment, RFM_Score FROM rfm"))
def q_rfm_scores(spark, sf_dir):
    return rfm_frames(spark, sf_dir)[1].select("customer_unique_id", "R", "F", "M", "RFM_Segment", "RFM_Score")


@register("rfm_segments", rfm_sql("SELECT customer_unique_id, R, F, Segment FROM rfm"))
def q_rfm_segments(spark, sf_dir):
    return rfm_frames(spark, sf_dir)[1].select("customer_unique_id", "R", "F", "Segment")


@register("value_tiers", rfm_sql("SELECT customer_unique_id, RFM_Score, Score FROM rfm"))
def q_value_tiers(spark, sf_dir):
    return rfm_frames(spark, sf_dir)[1].select("customer_unique_id", "RFM_Score", "Score")


FULL_COLS = ["customer_unique_id", "Recency", "Frequency", "R", "F", "M", "RFM_Segment", "RFM_Score", "Segment", "Score"]


@register("rfm_full", rfm_sql("SELECT " + ", ".join(FULL_COLS) + ", round(MonetaryValue, 6) AS MonetaryValue FROM rfm", "app"))
def q_rfm_full(spark, sf_dir):
    r = rfm_frames(spark, sf_dir, "app")[1]
    return r.select(*FULL_COLS, F.round("MonetaryValue", R6).alias("MonetaryValue"))


def _share(df, keys):
    return rf.group_share(df, keys).withColumn("percent", F.round("percent", R6))


def _share_sql_rounded(keys, preset="notebook"):
    k = ", ".join(keys)
    return rfm_sql(f"SELECT {k}, Count, round(percent, 6) AS percent FROM (SELECT {k}, CAST(count(*) AS BIGINT) AS Count, "
                   f"count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM rfm GROUP BY {k})", preset)


@register("segment_share", _share_sql_rounded(["Segment"]))
def q_segment_share(spark, sf_dir):
    return _share(rfm_frames(spark, sf_dir)[1], ["Segment"])


@register("tier_share", _share_sql_rounded(["Score"]))
def q_tier_share(spark, sf_dir):
    return _share(rfm_frames(spark, sf_dir)[1], ["Score"])


@register("combo_share", _share_sql_rounded(["F", "Segment", "Score"]))
def q_combo_share(spark, sf_dir):
    """Share per (group, segment, tier); the group column here is the F score
    (the clustered variant is ``cluster_combo_share``)."""
    return _share(rfm_frames(spark, sf_dir)[1], ["F", "Segment", "Score"])


@register("segment_hierarchy", rfm_sql(
    "SELECT CAST(F AS INTEGER) AS F, Segment, Score, CAST(count(*) AS BIGINT) AS Count, CAST(GROUPING(F, Segment, Score) AS BIGINT) AS level_id "
    "FROM rfm GROUP BY ROLLUP (F, Segment, Score)"))
def q_segment_hierarchy(spark, sf_dir):
    return rf.segment_hierarchy(rfm_frames(spark, sf_dir)[1], ["F", "Segment", "Score"])


GCC_COLS = ["customer_unique_id", "Recency", "Frequency", "MonetaryValue", "R", "F", "M", "RFM_Segment", "RFM_Score"]


@register("group_column_counts", rfm_sql(" UNION ALL ".join(
    f"SELECT Segment, '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS non_null FROM rfm GROUP BY Segment" for c in GCC_COLS)))
def q_group_column_counts(spark, sf_dir):
    from lapse.operators.profile import group_column_counts
    return group_column_counts(rfm_frames(spark, sf_dir)[1], ["Segment"], GCC_COLS)


@register("segment_caption", rfm_sql(
    "SELECT Segment, Count, Segment || '<br>Количество: ' || CAST(Count AS VARCHAR) || '<br>' || "
    "CAST(round_even(percent, 1) AS VARCHAR) || '%' AS display_text FROM (SELECT Segment, CAST(count(*) AS BIGINT) AS Count, "
    "count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM rfm GROUP BY Segment)"))
def q_segment_caption(spark, sf_dir):
    s = rf.segment_caption(rf.group_share(rfm_frames(spark, sf_dir)[1], ["Segment"]))
    return s.select("Segment", "Count", "display_text")
