"""Order rhythm and churn labelling.

A customer is *lost* when the idle time since the last order exceeds
``multiplier`` x their own median gap between orders, or the global
threshold (the mean over customers of those medians) when they have no
usable median.

Scale design
------------
* No window and no task is keyed by a customer. Points are dealt by ranges of
  (customer, time), sorted and read once, each row against the one before it;
  what a range cannot see, the row before its first, is carried over from the
  end of the previous range by a join on one row a range
  (:func:`lapse.operators.ordered.with_previous`). A customer holding a third
  of all rows, within minutes or years, is spread over a third of the tasks.
  Repeats of a (customer, time) point are counted as zero gaps before that.
* The median per customer is ``percentile(gap, 0.5, count)`` over the gap
  histogram, so its buffer is bounded by distinct gap values (whole days),
  not by the customer's row count.
* Scalars (analysis date, threshold) are one-row aggregates attached as
  scalar subqueries (evaluated once, used as constants).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions.time import as_ts, elapsed_days, plus_days
from lapse.operators.ordered import range_count, with_previous
from lapse.session import materialize, with_scalars

CUSTOMER = "customer_unique_id"
ORDER = "order_id"
TS = "order_purchase_timestamp"


def analysis_date(df: DataFrame, ts: str = TS, days: int = 1) -> DataFrame:
    """One row: latest timestamp + ``days``."""
    return df.agg(plus_days(F.max(as_ts(ts)), days).alias("analysis_date"))


def order_gaps(df: DataFrame, customer: str = CUSTOMER, order: str = ORDER,
               ts: str = TS, ranges: int | None = None) -> DataFrame:
    """Row-level gap to the previous row of the same customer, floored days
    (F1); ties on the timestamp are ordered by the order key.

    ``ranges`` is the number of tasks that the rows are dealt to (the shuffle
    partitions by default), more where a task would have to sort over
    ``ordered.RANGE_ROWS`` rows; answers do not depend on it. Rows without a
    customer or time belong to no group: their gap is NULL. The operator's own
    columns start with ``_prev`` and ``_t``."""
    valid = F.col(customer).isNotNull() & F.col(ts).isNotNull()
    good = df.where(valid).withColumn("_t", as_ts(ts))
    good = with_previous(good, customer, ["_t", order], "_t", "_prev_t", range_count(df, ranges))
    good = good.withColumn("gap_days", elapsed_days("_t", "_prev_t")).drop("_t", "_prev_t")
    rest = df.where(~valid).withColumn("gap_days", F.lit(None).cast("bigint"))
    return good.unionByName(rest)


def gap_histogram(df: DataFrame, customer: str = CUSTOMER, ts: str = TS,
                  ranges: int | None = None) -> DataFrame:
    """Multiset of gaps (floored days) between consecutive rows of each
    customer, as ``(customer, gap_days, n)``.

    Equal to counting ``order_gaps`` per ``(customer, gap)``, without ever
    sorting one customer's rows in one task (see module notes).
    """
    points = (df.where(F.col(customer).isNotNull() & F.col(ts).isNotNull())
              .groupBy(customer, as_ts(ts).alias("_t")).agg(F.count("*").alias("_n")))
    linked = with_previous(points, customer, ["_t"], "_t", "_prev_t", range_count(df, ranges))
    # repeats of a (customer, time) point are zero gaps: n - 1 of them
    gaps = F.array(F.struct(elapsed_days("_t", "_prev_t").alias("gap_days"), F.lit(1).cast("bigint").alias("n")),
                   F.struct(F.lit(0).cast("bigint").alias("gap_days"), (F.col("_n") - 1).alias("n")))
    return (linked.select(customer, F.explode(gaps).alias("_g")).where("_g.gap_days IS NOT NULL AND _g.n > 0")
            .groupBy(customer, "_g.gap_days").agg(F.sum("_g.n").alias("n")))


def customer_intervals(df: DataFrame, customer: str = CUSTOMER, ts: str = TS,
                       ranges: int | None = None) -> DataFrame:
    """Median gap per customer with at least one gap."""
    h = gap_histogram(df, customer, ts, ranges)
    return h.groupBy(customer).agg(
        F.expr("percentile(gap_days, 0.5, n)").alias("median_interval_days"))


def customer_features(df: DataFrame, customer: str = CUSTOMER, order: str = ORDER,
                      ts: str = TS, ranges: int | None = None) -> DataFrame:
    """Per customer: last order time, distinct orders, median gap and whole
    days idle before the analysis date (G1 = E2 + E3 + E4). The analysis
    date (latest time + 1 day) is taken from the per-customer maxima, so the
    input is scanned by two aggregations only (stats and gap points)."""
    stats = df.where(F.col(customer).isNotNull()).groupBy(customer).agg(
        F.max(as_ts(ts)).alias("last_order_date"),
        F.count_distinct(order).alias("order_count"))
    med = customer_intervals(df, customer, ts, ranges)
    feats = stats.join(med, customer, "left")
    return (with_scalars(feats, analysis_date(stats, "last_order_date"))
            .withColumn("days_since_last_order", elapsed_days("analysis_date", "last_order_date"))
            .drop("analysis_date"))


def global_threshold(features: DataFrame, median_col: str = "median_interval_days") -> DataFrame:
    """One row: mean over customers of their median gap, NULLs skipped (E5)."""
    return features.agg(F.avg(median_col).alias("threshold"))


def churn_flag(order_count, median, days_since, threshold, multiplier: float = 2.0):
    """Nested condition of G2 as one expression."""
    fallback = (F.col(order_count) == 1) | F.col(median).isNull() | (F.col(median) <= 0)
    limit = F.when(fallback, F.col(threshold)).otherwise(F.col(median) * F.lit(multiplier))
    return F.coalesce(F.col(days_since) > limit, F.lit(False)).cast("int")


def churn_labels(df: DataFrame, customer: str = CUSTOMER, order: str = ORDER,
                 ts: str = TS, multiplier: float = 2.0,
                 ranges: int | None = None) -> DataFrame:
    """Customer features plus ``is_churned``.

    The features (one row per customer) are read twice, for the threshold and
    for the labels, so they are materialised; the stored table also leaves the
    joins on the label table to be split where one customer holds many rows."""
    feats = materialize(customer_features(df, customer, order, ts, ranges), "customer_features")
    return (with_scalars(feats, global_threshold(feats))
            .withColumn("is_churned", churn_flag("order_count", "median_interval_days",
                                                  "days_since_last_order", "threshold", multiplier)))


def repeat_customers(df: DataFrame, customer: str = CUSTOMER, order: str = ORDER) -> DataFrame:
    """One row: customers with more than one distinct order, and their share
    of the number of order *rows* (E1, C10), as the reference divides."""
    per = df.where(F.col(customer).isNotNull()).groupBy(customer).agg(
        F.count_distinct(order).alias("n_orders"))
    rep = per.agg(F.count_if(F.col("n_orders") > 1).alias("repeat_customers"))
    rows = df.agg(F.count("*").alias("order_rows"))
    return (with_scalars(rep, rows)
            .withColumn("repeat_share_pct",
                        F.col("repeat_customers") / F.col("order_rows") * 100))


def order_counts(df: DataFrame, customer: str = CUSTOMER, order: str = ORDER,
                 name: str = "quantity") -> DataFrame:
    """Each customer's number of distinct orders, one row per customer (F2)."""
    return df.groupBy(customer).agg(F.count_distinct(order).alias(name))


def with_order_count(df: DataFrame, customer: str = CUSTOMER, order: str = ORDER,
                     name: str = "quantity") -> DataFrame:
    """Each row gets its customer's distinct order count (F2): aggregate,
    materialise (one row per customer), then join back on the key. The stored
    side brings its own exchange, so AQE can split a skewed key's partition."""
    per = materialize(order_counts(df, customer, order, name), "order_count")
    return df.join(per, customer, "left")


def attach_customer(df: DataFrame, per_customer: DataFrame, customer: str = CUSTOMER,
                    columns: list[str] | None = None) -> DataFrame:
    """Left-join per-customer columns back onto a row-level frame."""
    if columns is not None:
        per_customer = per_customer.select(customer, *columns)
    return df.join(per_customer, customer, "left")
