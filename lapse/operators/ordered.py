"""Exact global-order statistics without a single-task window.

Quantiles, dense ranks and cumulative counts need a total order over a
column. A window without ``partitionBy`` would pull every row into one task,
so instead:

1. rows are reduced to distinct values with their counts (partial
   aggregation before the shuffle; a value held by a third of the rows is one
   row afterwards);
2. distinct values are cut into ``buckets`` ranges at approximate quantiles
   (``spark.sql.shuffle.partitions`` ranges unless given; the cut points are
   computed once and stored, so that every consumer sees the same buckets);
3. bucket totals (``buckets`` rows) get prefix offsets in a tiny window;
4. within each bucket a window ordered by value adds the running count.

The result is exact and the same for any number of buckets; approximation
only balances them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from lapse.functions.util import count_below
from lapse.operators import selection
from lapse.session import materialize, ship_by_value, with_scalars


_NUMERIC = ("byte", "short", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def _bucketed(values: DataFrame, v: str, buckets: int, by: list[str]) -> DataFrame:
    """Add ``_b``: a bucket id that is non-decreasing in ``v`` within each
    ``by`` group, equal values always sharing a bucket."""
    vtype = dict(values.dtypes)[v]
    if not (vtype in _NUMERIC or vtype.startswith("decimal")):
        # Text and other orderable types: range-partition on (by, v) and use
        # the partition index (range bounds keep equal keys together). The
        # bounds are sampled, so the numbered values are stored: a second
        # evaluation could cut elsewhere.
        return materialize(values.repartitionByRange(buckets, *by, v).withColumn("_b", F.spark_partition_id()), "ranges")
    probs = [i / buckets for i in range(1, buckets)] or [1.0]
    x = F.col(v).cast("double")
    cuts = materialize(values.groupBy(*by).agg(F.percentile_approx(x, probs, 10000).alias("_cuts")), "cuts")
    # one row of cut points per group; AQE broadcasts it by its measured size
    joined = with_scalars(values, cuts) if not by else values.join(cuts, by)
    return joined.withColumn("_b", count_below("_cuts", x, len(probs))).drop("_cuts")


def default_buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def value_counts_cumulative(df: DataFrame, v: str, weight: str | None = None,
                            by: list[str] | None = None, buckets: int | None = None,
                            descending: bool = False) -> DataFrame:
    """Distinct values of ``v`` (per ``by`` group) with ``cnt`` and ``cum_before``.

    ``cum_before`` is the weighted number of rows strictly before the value
    in the order (ascending unless ``descending``); ``dense_rank`` is the
    0-based position of the value among distinct values. NULLs are skipped.
    ``by`` groups must be few (a handful of columns or models).
    """
    by = by or []
    buckets = default_buckets(df) if buckets is None else buckets
    w = F.col(weight) if weight else F.lit(1)
    vals = (df.where(F.col(v).isNotNull())
            .groupBy(*by, v).agg(F.sum(w).alias("cnt"), F.lit(1).alias("_one")))
    key = F.col(v).desc() if descending else F.col(v).asc()
    vals = _bucketed(vals, v, buckets, by)
    if descending:
        vals = vals.withColumn("_b", F.lit(buckets) - F.col("_b"))
    totals = vals.groupBy(*by, "_b").agg(F.sum("cnt").alias("_bt"), F.count("*").alias("_bn"))
    wb = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_b",
                            F.coalesce(F.sum("_bt").over(wb), F.lit(0)).alias("_off"),
                            F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_roff"))
    # offsets has one row per (group, bucket): small, AQE broadcasts it.
    wi = Window.partitionBy(*by, "_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    wr = Window.partitionBy(*by, "_b").orderBy(key)
    return (vals.join(offsets, [*by, "_b"])
            .withColumn("cum_before", F.col("_off") + F.coalesce(F.sum("cnt").over(wi), F.lit(0)))
            .withColumn("dense_rank", F.col("_roff") + F.row_number().over(wr) - 1)
            .drop("_b", "_off", "_roff", "_one"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    buckets: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles (as ``percentile``), long form
    ``(column_name, p, value)``; exact and distributed, by bracket selection
    (:mod:`lapse.operators.selection`). ``buckets`` sets how finely the sketch
    cuts; the answer does not depend on it."""
    return selection.exact_quantiles(df, cols, probs, *([] if buckets is None else [max(buckets, 2), 10 * max(buckets, 2)]))


def quantiles(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact",
              accuracy: int = 10000, buckets: int | None = None) -> DataFrame:
    """Quantiles of several columns, long form ``(column_name, p, value)``.

    ``exact``: distributed exact (see module notes). ``builtin``: Spark's
    ``percentile`` (exact; its buffer holds one entry per distinct value,
    merged in one task: right for low-cardinality columns such as days or
    order counts). ``approx``: ``percentile_approx`` (rank error 1/accuracy).
    """
    if method == "exact":
        return exact_quantiles(df, cols, probs, buckets)
    fn = (lambda c: F.percentile(F.col(c), probs)) if method == "builtin" else \
         (lambda c: F.percentile_approx(F.col(c), probs, accuracy))
    wide = df.agg(*[fn(c).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "_arr") if len(cols) > 1 else \
        wide.select(F.lit(cols[0]).alias("column_name"), F.col(cols[0]).alias("_arr"))
    return (long.select("column_name", F.posexplode("_arr").alias("_i", "value"))
            .withColumn("p", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1))
            .select("column_name", "p", F.col("value").cast("double").alias("value")))


def quantile_row(qlong: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Pivot long quantiles into one row with columns ``{col}_q{i}``."""
    aggs = []
    for c in cols:
        for i, p in enumerate(probs):
            aggs.append(F.max(F.when((F.col("column_name") == c) & (F.abs(F.col("p") - p) < 1e-12),
                                     F.col("value"))).alias(f"{c}_q{i}"))
    return qlong.agg(*aggs)


def running_sums(values: DataFrame, v: str, weights: list[str], buckets: int | None = None) -> DataFrame:
    """One row per distinct ``v`` with whole-number ``weights``: adds ``{weight}_below``, the weight of smaller values.

    ``values`` is stored once; its rows are cut to ranges at sketched cut
    points, ranges get offsets from one small table, and each range is summed
    by itself: all weights in one pass, no join of the values with themselves.
    """
    buckets = default_buckets(values) if buckets is None else buckets
    kept = _bucketed(materialize(values, "running"), v, buckets, [])
    totals = kept.groupBy("_b").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select(F.col("_b").alias("_of"), *[F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}") for w in weights])
    inner = Window.partitionBy("_b").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    joined = kept.join(offsets, F.col("_b") == F.col("_of"))
    return joined.select(*values.columns, *[(F.col(f"_o_{w}") + F.coalesce(F.sum(w).over(inner), F.lit(0))).alias(f"{w}_below") for w in weights])


RANGE_ROWS = 1 << 21  # rows that one task may sort as a range (some 200 MB)


def range_count(df: DataFrame, ranges: int | None) -> int | None:
    """``ranges``, or as many more as keep each to :data:`RANGE_ROWS` rows of ``df``; None (the session's number) stays."""
    return None if ranges is None else max(ranges, -(-df.count() // RANGE_ROWS))


def with_previous(df: DataFrame, group: str, order: list[str], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row before it in ``order`` within ``group`` (NULL for a group's first row).

    Rows are dealt by ranges of (group, order, hash of the row) and sorted, so
    a group of any size is spread over tasks; a task reads its rows once, each
    against the one before. Each range's first row then takes the last row of
    the range before, by a join on one row a range. Only rows equal in all
    columns cannot be told apart by ranges. ``group`` must not be NULL; columns
    named ``_range``, ``_head`` or ``_tie`` are not allowed.
    """
    ship_by_value(__name__)
    keys = [group, *order]
    at_group, at_value = df.columns.index(group), df.columns.index(value)
    schema = StructType([*df.schema.fields, StructField(out, df.schema[value].dataType), StructField("_range", IntegerType()), StructField("_head", BooleanType())])

    def scan(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        last, part = None, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            g, v = b.column(at_group), b.column(at_value)
            head = last is None
            before = pa.array([None], g.type), pa.array([None], v.type)
            g_prev = pa.concat_arrays([before[0] if head else last[0], g.slice(0, len(g) - 1)])
            v_prev = pa.concat_arrays([before[1] if head else last[1], v.slice(0, len(v) - 1)])
            same = pc.fill_null(pc.equal(g, g_prev), False)
            prev = pc.if_else(same, v_prev, pa.scalar(None, v.type))
            first = pa.array([head] + [False] * (len(g) - 1))
            yield pa.RecordBatch.from_arrays([*b.columns, prev, pa.array([part] * len(g), pa.int32()), first], names=schema.names)
            last = g.slice(len(g) - 1), v.slice(len(v) - 1)

    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    # without a number AQE may join neighbouring ranges that are small; they stay in order
    ranged = tied.repartitionByRange(*keys, "_tie") if ranges is None else tied.repartitionByRange(ranges, *keys, "_tie")
    dealt = ranged.sortWithinPartitions(*keys, "_tie").drop("_tie")
    rows = materialize(dealt.mapInArrow(scan, schema), "previous")
    last = rows.groupBy("_range").agg(F.max(F.struct(*keys, F.col(value).alias("_value"))).alias("_last"))
    carry = last.select(F.col("_range").alias("_of"), F.lag("_last").over(Window.orderBy("_range")).alias("_last"))  # one row a range
    take = F.col("_head") & (F.col(f"_last.{group}") == F.col(group))
    joined = rows.join(carry, (F.col("_range") == F.col("_of")) & F.col("_head"), "left")
    return joined.withColumn(out, F.when(take, F.col("_last._value")).otherwise(F.col(out))).select(*df.columns, out)


def dense_codes(df: DataFrame, c: str, out: str | None = None, buckets: int | None = None) -> DataFrame:
    """Code each distinct value of ``c`` by its 0-based ascending position
    (label encoding); returns ``(c, out)`` one row per distinct value."""
    out = out or f"{c}_code"
    d = value_counts_cumulative(df, c, buckets=buckets)
    return d.select(c, F.col("dense_rank").alias(out))
