"""Map aggregates.

Per-prefix metrics are keyed by a 3-digit zip prefix: at most 1,000 keys
whatever the data size, so attaching them to point rows is a broadcast join
with a proven bound. Order totals are computed before the per-prefix mean
(two-level aggregation; the first level is keyed by order, so no prefix
becomes one hot task).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.functions.util import col, fixed_mean, fixed_sum
from lapse.operators.ordered import quantile_row, quantiles
from lapse.session import with_scalars

EARTH_RADIUS = 6378137.0

# Bounding box of the served region, inclusive.
BOUNDING_BOX = {"lat_min": -33.75116944, "lat_max": 5.27438888,
                "lng_min": -73.98283055, "lng_max": -34.79314722}

PREFIX3 = "geolocation_zip_code_prefix_3_digits"
CUST_PREFIX3 = "customer_zip_code_prefix_3_digits"


def web_mercator(lng, lat) -> tuple[Column, Column]:
    """Longitude/latitude in degrees → web-mercator metres."""
    x = col(lng) * F.lit(math.pi * EARTH_RADIUS / 180.0)
    y = F.ln(F.tan((F.lit(90.0) + col(lat)) * F.lit(math.pi / 360.0))) * F.lit(EARTH_RADIUS)
    return x, y


def prefix_columns(df: DataFrame, c: str, lengths=range(1, 5), name: str | None = None,
                   as_int: bool = True) -> DataFrame:
    """Leading 1..4 characters of a code as new columns."""
    name = name or c
    out = {}
    for n in lengths:
        p = F.substring(col(c), 1, n)
        out[f"{name}_{n}_digits"] = p.cast("int") if as_int else p
    return df.withColumns(out)


def in_bounding_box(df: DataFrame, box: dict | None = None, lat: str = "geolocation_lat",
                    lng: str = "geolocation_lng") -> DataFrame:
    """Rows inside the box, borders included (C6); a plain range filter that
    parquet can use for row-group skipping."""
    b = box or BOUNDING_BOX
    return df.where((F.col(lat) <= b["lat_max"]) & (F.col(lng) >= b["lng_min"])
                    & (F.col(lat) >= b["lat_min"]) & (F.col(lng) <= b["lng_max"]))


def geo_points(geolocation: DataFrame, box: dict | None = None) -> DataFrame:
    """Geolocation rows with prefixes, inside the box, with mercator x/y."""
    g = prefix_columns(geolocation, "geolocation_zip_code_prefix", as_int=False)
    g = in_bounding_box(g, box)
    x, y = web_mercator("geolocation_lng", "geolocation_lat")
    g = g.withColumns({"x": x, "y": y})
    return g.withColumns({f"geolocation_zip_code_prefix_{n}_digits":
                          F.col(f"geolocation_zip_code_prefix_{n}_digits").cast("int") for n in range(1, 5)})


def sales_lines(orders: DataFrame, items: DataFrame, customers: DataFrame, reviews: DataFrame) -> DataFrame:
    """orders ⋈ items ⋈ customers ⋈ reviews, inner (D11); one row per item
    and review. Adds the customer's 3-digit zip prefix."""
    cust = customers.withColumn(CUST_PREFIX3, F.substring("customer_zip_code_prefix", 1, 3).cast("int"))
    return (orders.join(items, "order_id").join(cust, "customer_id").join(reviews, "order_id"))


def filter_region(geo: DataFrame, sales: DataFrame, state: str | None = None, city: str | None = None):
    """Drill down by state, then case-insensitive city (C8); returns both
    filtered frames."""
    if state is not None:
        geo = geo.where(F.col("geolocation_state") == state)
        sales = sales.where(F.col("customer_state") == state)
        if city is not None:
            geo = geo.where(F.lower("geolocation_city") == city.lower())
            sales = sales.where(F.lower("customer_city") == city.lower())
    return geo, sales


def clip_outliers(df: DataFrame, cols=("x", "y"), lo: float = 0.001, hi: float = 0.999,
                  method: str = "exact") -> DataFrame:
    """Keep rows between the ``lo`` and ``hi`` quantiles of every column,
    borders included (C7). Cut points are scalar subqueries."""
    cols = list(cols)
    q = quantile_row(quantiles(df, cols, [lo, hi], method), cols, [lo, hi])
    cond = None
    for c in cols:
        k = F.col(c).between(F.col(f"{c}_q0"), F.col(f"{c}_q1"))
        cond = k if cond is None else cond & k
    return with_scalars(df, q).where(cond).drop(*q.columns)


def attach_prefix_metric(geo: DataFrame, metric: DataFrame, key: str = PREFIX3,
                         metric_key: str = CUST_PREFIX3) -> DataFrame:
    """geo rows ⟕ per-prefix metric (D13); the metric side is keyed by a
    3-digit prefix (≤ 1,000 rows) by default, and AQE broadcasts it by its size."""
    m = metric.withColumnRenamed(metric_key, key)
    return geo.join(m, key, "left")


def geo_revenue(geo: DataFrame, sales: DataFrame) -> DataFrame:
    """Sum of item price per prefix on each point, in thousands."""
    per = sales.where(F.col(CUST_PREFIX3).isNotNull()).groupBy(CUST_PREFIX3).agg(F.sum("price").alias("price"))
    return (attach_prefix_metric(geo, per)
            .withColumn("revenue", F.coalesce(F.col("price"), F.lit(0.0)) / 1000))


def _order_totals(sales: DataFrame, with_freight: bool = False) -> DataFrame:
    aggs = [F.sum("price").alias("price"), F.min(CUST_PREFIX3).alias(CUST_PREFIX3)]
    if with_freight:
        aggs.append(F.sum("freight_value").alias("freight_value"))
    return sales.groupBy("order_id").agg(*aggs)


def geo_avg_ticket(geo: DataFrame, sales: DataFrame) -> DataFrame:
    """Mean order total per prefix on each point.

    Totals are summed in whole micro-units (decimals) and divided once, so the mean
    is the same double whatever order partial sums arrive in."""
    micro = F.round(F.col("price") * F.lit(1e6)).cast("decimal(28,0)")
    totals = sales.groupBy("order_id").agg(F.sum(micro).alias("_pm"), F.min(CUST_PREFIX3).alias(CUST_PREFIX3))
    per = (totals.where(F.col(CUST_PREFIX3).isNotNull()).groupBy(CUST_PREFIX3)
           .agg((F.sum("_pm").cast("double") / F.count("*") / F.lit(1e6)).alias("avg_ticket")))
    return attach_prefix_metric(geo, per)


def geo_freight_ratio(geo: DataFrame, sales: DataFrame) -> DataFrame:
    """Mean of per-order freight / price per prefix, orders with a positive
    total only (E22, C9)."""
    t = _order_totals(sales, with_freight=True).where(F.col("price") > 0)
    per = (t.withColumn("freight_ratio", F.col("freight_value") / F.col("price"))
           .where(F.col(CUST_PREFIX3).isNotNull())
           .groupBy(CUST_PREFIX3).agg(F.avg("freight_ratio").alias("freight_ratio")))
    return attach_prefix_metric(geo, per)


def geo_metrics(geo: DataFrame, sales: DataFrame) -> DataFrame:
    """``revenue``, ``avg_ticket`` and ``freight_ratio`` of each point's
    prefix at once (E20-E22): one table of order totals, one of prefixes, one
    join. The single metrics above give the same columns."""
    micro = F.round(F.col("price") * F.lit(1e6)).cast("decimal(28,0)")
    order = sales.groupBy("order_id").agg(
        F.sum("price").alias("price"), F.sum(micro).alias("_pm"), F.sum("freight_value").alias("freight_value"),
        F.min(CUST_PREFIX3).alias(CUST_PREFIX3))
    ratio = F.when(F.col("price") > 0, F.col("freight_value") / F.col("price"))
    per = (order.where(F.col(CUST_PREFIX3).isNotNull()).groupBy(CUST_PREFIX3)
           .agg(F.sum("price").alias("price"), (F.sum("_pm").cast("double") / F.count("*") / F.lit(1e6)).alias("avg_ticket"),
                F.avg(ratio).alias("freight_ratio")))
    return (attach_prefix_metric(geo, per)
            .withColumn("revenue", F.coalesce(F.col("price"), F.lit(0.0)) / 1000))


def geo_headline_of(metrics: DataFrame) -> DataFrame:
    """The figures of :func:`geo_headline` from :func:`geo_metrics`, in one aggregate."""
    return metrics.agg(F.count("*").alias("points"), fixed_sum("revenue").alias("revenue_total"),
                       F.avg("avg_ticket").alias("mean_ticket"), F.avg("freight_ratio").alias("mean_freight_ratio"))


def geo_headline(revenue: DataFrame, avg_ticket: DataFrame, freight: DataFrame,
                 dedupe: bool = False) -> DataFrame:
    """Point count, revenue total (k), mean ticket, mean freight ratio.

    ``dedupe=False`` sums the per-prefix revenue over every point as the
    reference does (T20); ``True`` counts each prefix once.
    """
    rev = revenue
    if dedupe:
        rev = revenue.select(PREFIX3, "revenue").dropDuplicates([PREFIX3])
    a = revenue.agg(F.count("*").alias("points"))
    b = rev.agg(fixed_sum("revenue").alias("revenue_total"))  # money: exact sum
    c = avg_ticket.agg(F.avg("avg_ticket").alias("mean_ticket"))
    d = freight.agg(F.avg("freight_ratio").alias("mean_freight_ratio"))
    return with_scalars(with_scalars(with_scalars(a, b), c), d)


def raster_mean(df: DataFrame, x: str, y: str, v: str, width: int = 50, height: int = 25,
                extent: tuple | None = None, exact_digits: int | None = None) -> DataFrame:
    """Mean of ``v`` on a ``width`` x ``height`` grid over the point extent
    (E27). Cells are ``least(floor((x-xmin)/(xmax-xmin)*w), w-1)``; points
    outside a given extent are dropped; empty cells are absent.
    ``exact_digits`` takes the mean in fixed point for values exact at that
    many decimals (money), independent of summation order."""
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if extent is None:
        ext = src.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    else:
        spark = df.sparkSession
        ext = spark.createDataFrame([tuple(float(e) for e in extent)], "_x0 double, _x1 double, _y0 double, _y1 double")
    j = with_scalars(src, ext).where(F.col(x).between(F.col("_x0"), F.col("_x1"))
                                     & F.col(y).between(F.col("_y0"), F.col("_y1")))

    def cell(c, lo, hi, n):
        span = F.col(hi) - F.col(lo)
        return F.when(span == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col(c) - F.col(lo)) / span * F.lit(n)), F.lit(n - 1))).cast("int")
    g = j.withColumns({"col": cell(x, "_x0", "_x1", width), "row": cell(y, "_y0", "_y1", height)})
    mean = fixed_mean(v, exact_digits) if exact_digits is not None else F.avg(v)
    return g.groupBy("col", "row").agg(mean.alias("mean"), F.count(v).alias("n"))
