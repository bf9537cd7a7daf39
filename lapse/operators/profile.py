"""Profiling (A7-A10): each is one aggregation job, never a driver loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL count per column, long form ``(column_name, nulls)``."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "nulls")


def row_profile(df: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Row count and distinct count of each id column (A8), one row."""
    ids = ids or []
    return df.agg(F.count("*").alias("rows"),
                  *[F.count_distinct(c).alias(f"distinct_{c}") for c in ids])


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row exactly (A9): rows - distinct rows.

    One pass: group on all columns (NULLs group together) and sum n-1.
    """
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def category_profile(df: DataFrame, cols: list[str], n: int = 3) -> DataFrame:
    """Distinct count and the ``n`` most frequent values of each column
    (A10), long form ``(column_name, distinct_values, rank, value, count)``.

    Values are unpivoted to text, counted per (column, value), and ranked
    within each column; the rank window only sees one row per distinct value.
    Ties on the count are broken by the value.
    """
    long = df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("count"))
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    distinct = counts.groupBy("column_name").agg(F.count("*").alias("distinct_values"))
    return ranked.where(F.col("rank") <= n).join(distinct, "column_name")


def group_column_counts(df: DataFrame, keys: list[str], cols: list[str] | None = None) -> DataFrame:
    """Non-NULL count of each column per group, long form
    ``(*keys, column_name, non_null)`` (E15); one aggregation."""
    cols = cols or [c for c in df.columns if c not in keys]
    wide = df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols])
    return wide.unpivot(keys, cols, "column_name", "non_null")
