"""Dashboard and report aggregates (C4, C5, C11, E8, E10, E11, E16-E19,
E25, E26, F4, F7)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions.util import col
from lapse.session import with_scalars

CUSTOMER = "customer_unique_id"


def filter_population(df: DataFrame, states=None, score_range: tuple | None = None,
                      state_col: str = "customer_state", score_col: str = "RFM_Score") -> DataFrame:
    """Membership + range filter (C5). ``states`` is a list (literal ``IN``,
    pushed to the scan) or a one-column DataFrame (left-semi join, for lists
    that grow with the data)."""
    out = df
    if states is not None:
        if isinstance(states, DataFrame):
            keys = states.select(F.col(states.columns[0]).alias(state_col)).distinct()
            out = out.join(keys, state_col, "left_semi")
        else:
            out = out.where(F.col(state_col).isin(list(states)))
    if score_range is not None:
        lo, hi = score_range
        out = out.where(F.col(score_col).between(lo, hi))
    return out


def customer_record(df: DataFrame, customer_id, order_by: list[str] | None = None,
                    customer: str = CUSTOMER) -> DataFrame:
    """The first row of one customer under an explicit total order."""
    order_by = order_by or df.columns
    if isinstance(customer_id, DataFrame):
        # a one-row frame holding the id (e.g. chosen by an aggregate)
        ids = customer_id.select(F.col(customer_id.columns[0]).alias("_id"))
        rows = df.join(ids, F.col(customer) == F.col("_id")).drop("_id")
    else:
        rows = df.where(F.col(customer) == F.lit(customer_id))
    return rows.orderBy(*order_by).limit(1)


def headline(df: DataFrame, customer: str = CUSTOMER, label: str = "is_churned",
             score: str = "RFM_Score") -> DataFrame:
    """Distinct customers, churn rate and mean RFM score over rows."""
    return df.agg(F.count_distinct(customer).alias("customers"),
                  F.avg(label).alias("churn_rate"),
                  F.avg(score).alias("mean_rfm_score"))


def churn_by(df: DataFrame, dims: list[str], label: str = "is_churned",
             unit: str = "row", customer: str = CUSTOMER) -> DataFrame:
    """Churn rate per group of ``dims`` (E16, E17). ``unit='row'`` weighs
    fact rows as the reference does (T21); ``'customer'`` counts each
    customer once per group (their label is constant)."""
    src = df.where(F.col(label).isNotNull())
    for d in dims:
        src = src.where(F.col(d).isNotNull())
    if unit == "customer":
        src = src.select(*dims, customer, label).dropDuplicates([*dims, customer])
    return src.groupBy(*dims).agg(F.avg(label).alias("churn_rate"), F.count("*").alias("n"))


def count_by(df: DataFrame, c: str, unit: str = "row", customer: str = CUSTOMER,
             name: str = "count") -> DataFrame:
    """Rows (or distinct customers) per value of ``c``."""
    src = df.where(F.col(c).isNotNull())
    agg = F.count("*") if unit == "row" else F.count_distinct(customer)
    return src.groupBy(c).agg(agg.alias(name))


def value_share(df: DataFrame, c: str) -> DataFrame:
    """Share of each value of ``c`` in percent of non-null rows."""
    g = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("_t"))
    return with_scalars(g, total).withColumn("percent", F.col("n") * 100.0 / F.col("_t")).drop("_t")


def on_time_share(df: DataFrame, delay: str = "delivery_delay") -> DataFrame:
    """Percent of rows delivered on or before the estimate."""
    return df.agg((F.count_if(F.col(delay) <= 0) / F.count("*") * 100).alias("on_time_pct"),
                  F.count("*").alias("rows"))


def value_range(df: DataFrame, c: str) -> DataFrame:
    """min and max of ``c``."""
    return df.agg(F.min(c).alias("min"), F.max(c).alias("max"))


def top_n(df: DataFrame, order_col: str, n: int, ascending: bool = False,
          tie_breakers: list[str] | None = None) -> DataFrame:
    """First ``n`` rows by ``order_col`` (F4); planned as TakeOrderedAndProject
    (per-partition top-n, then a merge of n x partitions rows)."""
    key = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    return df.orderBy(key, *(tie_breakers or [])).limit(n)


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """Sorted distinct non-null values."""
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def histogram(df: DataFrame, c: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width histogram between min and max, last bin closed.

    Output ``(by?, bin, lower, upper, count)``; empty bins are absent. The
    extent is a one-row aggregate attached as scalar subqueries.
    """
    src = df.where(F.col(c).isNotNull())
    ext = src.agg(F.min(c).cast("double").alias("_lo"), F.max(c).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((col(c).cast("double") - F.col("_lo")) / width), F.lit(bins - 1)))
    keys = ([by] if by else [])
    binned = with_scalars(src, ext).withColumn("bin", b.cast("int"))
    g = binned.groupBy(*keys, "bin", "_lo", "_hi").agg(F.count("*").alias("count"))
    return g.select(*keys, "bin",
                    (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("lower"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("upper"),
                    "count")


def density(df: DataFrame, c: str, points: int = 100, fineness: int = 64) -> DataFrame:
    """Gaussian kernel density on an even grid over [min, max].

    Bandwidth by Scott's rule, ``sample std x n^(-1/5)``. One aggregation
    reduces the rows to the nodes of a fine grid (at least ``fineness`` nodes
    a bandwidth and a grid step): a row is shared among its four nearest nodes
    by cubic interpolation, so a kernel summed over nodes differs from the one
    summed over rows by less than ``0.05 fineness^-4`` of its peak. The kernels
    of the ``points`` are then evaluated on nodes only, however many rows or
    distinct values there are. Fewer than two distinct values have no bandwidth:
    the density is NULL.
    """
    src = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("_x"))
    stats = src.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
                    F.stddev_samp("_x").alias("_sd"), F.count("*").alias("_n"))
    h = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    span = F.col("_hi") - F.col("_lo")
    cells = F.greatest(F.lit(fineness * max(points - 1, 1)).cast("double"), F.coalesce(F.ceil(F.try_divide(span * F.lit(fineness), h)).cast("double"), F.lit(1.0)))
    grid = stats.withColumns({"_h": h, "_cells": cells}).withColumn("_d", span / F.col("_cells"))
    at = F.coalesce(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_d")), F.lit(0.0))
    cell = F.greatest(F.lit(0.0), F.least(F.floor(at).cast("double"), F.col("_cells") - 1))
    t = F.col("_t")
    shares = [-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6]
    binned = with_scalars(src, grid).select(cell.alias("_j"), (at - cell).alias("_t"))
    per_cell = binned.groupBy("_j").agg(*[F.sum(w).alias(f"_w{i}") for i, w in enumerate(shares)])
    node = F.explode(F.array(*[F.struct((F.col("_j") + (i - 1)).alias("node"), F.col(f"_w{i}").alias("w")) for i in range(4)])).alias("_s")
    nodes = per_cell.select(node).groupBy("_s.node").agg(F.sum("_s.w").alias("_w"))
    norm = 1.0 / math.sqrt(2 * math.pi)
    place = F.col("_lo") + F.col("node") * F.col("_d")
    j = with_scalars(nodes, grid)
    aggs = []
    for i in range(points):
        z = F.try_divide(F.col("_lo") + F.lit(i) * (span / F.lit(max(points - 1, 1))) - place, F.col("_h"))
        aggs.append(F.sum(F.col("_w") * F.lit(norm) * F.exp(-0.5 * z * z)).alias(f"d{i}"))
    ids = ["_lo", "_hi", "_h", "_n"]
    long = j.groupBy(*ids).agg(*aggs).unpivot(ids, [f"d{i}" for i in range(points)], "_k", "_s")
    point = F.substring("_k", 2, 10).cast("int")
    return long.select(point.alias("point"), (F.col("_lo") + point * span / max(points - 1, 1)).alias("x"),
                       F.try_divide(F.col("_s"), F.col("_n") * F.col("_h")).alias("density"))
