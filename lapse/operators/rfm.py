"""Recency / frequency / monetary analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions.rfm import (SCORE_PROBS, rfm_segment, rfm_segment_code,
                                 score_by_cuts, value_tier)
from lapse.functions.time import as_ts, calendar_days, elapsed_days
from lapse.functions.util import fixed_sum
from lapse.operators.lifecycle import analysis_date as _analysis_date
from lapse.operators.ordered import quantile_row, quantiles
from lapse.session import materialize, with_scalars

CUSTOMER = "customer_unique_id"
MEASURES = ["Recency", "Frequency", "MonetaryValue"]


def rfm_base(fact: DataFrame, recency: str = "calendar_approved", grain: str = "row",
             analysis_date: DataFrame | None = None, customer: str = CUSTOMER,
             order: str = "order_id", amount: str = "payment_value") -> DataFrame:
    """Recency, Frequency (distinct orders) and MonetaryValue per customer.

    ``recency='calendar_approved'`` (notebook): calendar days from the
    latest approval date over all rows to the customer's latest approval
    date. ``'elapsed_purchase'`` (app): floored days from ``analysis_date``
    (a one-row frame; default latest purchase + 1 day) to the customer's
    latest purchase.

    ``grain='row'`` sums the amount over fact rows as the reference does,
    fan-out included (T6); ``'payment'`` sums each distinct payment once.
    """
    money = fixed_sum(amount)
    src = fact.where(F.col(customer).isNotNull())
    if grain == "payment":
        pay_cols = [order, "payment_type", "payment_installments", amount]
        pay = src.select(customer, *pay_cols).dropDuplicates()
        monetary = pay.groupBy(customer).agg(money.alias("MonetaryValue"))
        money = None
    if recency == "calendar_approved":
        base = src.groupBy(customer).agg(
            F.max(as_ts("order_approved_at")).alias("_last"),
            F.count_distinct(order).alias("Frequency"),
            *([money.alias("MonetaryValue")] if money is not None else []))
        ref = src.agg(F.max(as_ts("order_approved_at")).alias("_ref"))
        out = with_scalars(base, ref).withColumn("Recency", calendar_days("_ref", "_last").cast("bigint"))
    elif recency == "elapsed_purchase":
        base = src.groupBy(customer).agg(
            F.max(as_ts("order_purchase_timestamp")).alias("_last"),
            F.count_distinct(order).alias("Frequency"),
            *([money.alias("MonetaryValue")] if money is not None else []))
        ref = analysis_date if analysis_date is not None else _analysis_date(src)
        ref = ref.select(F.col(ref.columns[0]).alias("_ref"))
        out = with_scalars(base, ref).withColumn("Recency", elapsed_days("_ref", "_last"))
    else:
        raise ValueError(recency)
    if grain == "payment":
        out = out.join(monetary, customer, "left")
    return out.select(customer, "Recency", "Frequency", "MonetaryValue")


# Recency (whole days) and Frequency (orders) take few distinct values
# whatever the data size, so Spark's exact ``percentile`` (one buffer entry
# per distinct value) is bounded for them; callers that know this name them
# in ``bounded``.
BOUNDED_MEASURES = ("Recency", "Frequency")


def rfm_quantiles(rfm: DataFrame, cols=MEASURES, probs=SCORE_PROBS, bounded=(),
                  buckets: int | None = None) -> DataFrame:
    """Score cut points, one row with ``{col}_q{i}`` columns.

    Exact and distributed; the columns in ``bounded`` (few distinct values)
    take Spark's built-in exact ``percentile``, with the same result.
    """
    cols, probs = list(cols), list(probs)
    small = [c for c in cols if c in bounded]
    large = [c for c in cols if c not in bounded]
    parts = ([quantiles(rfm, small, probs, "builtin")] if small else []) + \
            ([quantiles(rfm, large, probs, "exact", buckets=buckets)] if large else [])
    q = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return quantile_row(q, cols, probs)


def rfm_scores(rfm: DataFrame, bounded=BOUNDED_MEASURES, fill: bool = True) -> DataFrame:
    """R, F, M scores 1-5 at the 20/40/60/80 % cut points, RFM_Segment and
    RFM_Score (E9, B12, B22). ``fill`` applies the reference's NULL-to-0 and
    integer casts first (B15)."""
    if fill:
        rfm = rfm.withColumns({
            "Recency": F.coalesce(F.col("Recency"), F.lit(0)).cast("bigint"),
            "Frequency": F.coalesce(F.col("Frequency"), F.lit(0)).cast("bigint"),
            "MonetaryValue": F.coalesce(F.col("MonetaryValue"), F.lit(0.0)).cast("double"),
        })
    cuts = rfm_quantiles(rfm, bounded=bounded)
    n = len(SCORE_PROBS)
    scored = with_scalars(rfm, cuts).withColumns({
        "R": score_by_cuts("Recency", [f"Recency_q{i}" for i in range(n)], ascending=False),
        "F": score_by_cuts("Frequency", [f"Frequency_q{i}" for i in range(n)]),
        "M": score_by_cuts("MonetaryValue", [f"MonetaryValue_q{i}" for i in range(n)]),
    })
    scored = scored.withColumns({
        "RFM_Segment": rfm_segment_code("R", "F", "M"),
        "RFM_Score": F.col("R") + F.col("F") + F.col("M"),
    })
    return scored.drop(*[c for c in cuts.columns])


def rfm_labels(scored: DataFrame) -> DataFrame:
    """Segment and value-tier labels."""
    return scored.withColumns({"Segment": rfm_segment("R", "F"), "Score": value_tier("RFM_Score")})


def rfm(fact: DataFrame, recency: str = "calendar_approved", grain: str = "row",
        analysis_date: DataFrame | None = None, bounded=BOUNDED_MEASURES, base: DataFrame | None = None) -> DataFrame:
    """Full RFM table: measures, scores, segment code and label, tier.

    The cut points and the scores each read the measures, which are stored
    first (one row per customer), so that the fact is aggregated once;
    ``base`` names measures of :func:`rfm_base` that are stored already."""
    if base is None:
        base = materialize(rfm_base(fact, recency, grain, analysis_date), "rfm_base")
    return rfm_labels(rfm_scores(base, bounded))


def group_share(df: DataFrame, keys: list[str], count_col: str = "Count",
                divide_by: int = 1) -> DataFrame:
    """Rows per group and percent of all rows (E13, E28). ``divide_by``
    undoes a fan-out by a constant (melted tables, T13)."""
    g = df.groupBy(*keys).agg((F.count("*") / F.lit(divide_by)).cast("bigint").alias(count_col))
    total = g.agg(F.sum(count_col).alias("_total"))
    return (with_scalars(g, total)
            .withColumn("percent", F.col(count_col) * 100.0 / F.col("_total")).drop("_total"))


def segment_hierarchy(df: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Counts at every level of cluster → segment → tier, plus the root
    (E24): a ``rollup`` with ``grouping_id`` telling the level."""
    levels = levels or ["Cluster", "Segment", "Score"]
    return df.rollup(*levels).agg(F.count("*").alias("Count"),
                                  F.grouping_id().alias("level_id"))


# Caption layout of the segment tiles.
CAPTION_COUNT_LABEL = "Количество: "  # "Count: "


def segment_caption(shares: DataFrame, key: str = "Segment", count_col: str = "Count",
                    percent_col: str = "percent") -> DataFrame:
    """Tile caption '<segment><br>Количество: <count><br><percent>%' with the
    percent rounded half-even to one digit (B23, T25)."""
    pct = F.bround(F.col(percent_col), 1).cast("string")
    return shares.withColumn("display_text", F.concat(
        F.col(key), F.lit("<br>" + CAPTION_COUNT_LABEL), F.col(count_col).cast("string"),
        F.lit("<br>"), pct, F.lit("%")))
