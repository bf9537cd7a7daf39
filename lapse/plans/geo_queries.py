"""Registered queries: map points, prefixes, regional sales metrics, grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.functions.util import round_half_away
from lapse.operators import geo as gx
from lapse.plans.memo import fingerprint, memo
from lapse.plans.registry import register, with_ctes
from lapse.session import materialize
from lapse.sources.roles import Roles

R6 = 6
B = gx.BOUNDING_BOX
# Fixed parameters of the drill-down example (a dashboard selection).
REGION_STATE, REGION_CITY = "NATION_5", "Building"

GEO_ROLES = ["r_geolocation", "r_orders", "r_order_items", "r_customers", "r_order_reviews"]
GEO_CTES = [
    ("g0", "SELECT *, " + ", ".join(
        f"CAST(substr(geolocation_zip_code_prefix, 1, {n}) AS INTEGER) AS geolocation_zip_code_prefix_{n}_digits" for n in range(1, 5))
     + f" FROM r_geolocation WHERE geolocation_lat <= {B['lat_max']} AND geolocation_lng >= {B['lng_min']} "
       f"AND geolocation_lat >= {B['lat_min']} AND geolocation_lng <= {B['lng_max']}"),
    ("geo", "SELECT *, geolocation_lng * (pi() * 6378137.0 / 180.0) AS x, ln(tan((90.0 + geolocation_lat) * (pi() / 360.0))) * 6378137.0 AS y FROM g0"),
    ("gq", "SELECT quantile_cont(x, 0.001) AS x0, quantile_cont(x, 0.999) AS x1, quantile_cont(y, 0.001) AS y0, quantile_cont(y, 0.999) AS y1 FROM geo"),
    ("geoc", "SELECT geo.* FROM geo, gq WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"),
    ("sales", "SELECT o.order_id, i.price, i.freight_value, r.review_id, c.customer_state, c.customer_city, "
              "CAST(substr(c.customer_zip_code_prefix, 1, 3) AS INTEGER) AS customer_zip_code_prefix_3_digits "
              "FROM r_orders o JOIN r_order_items i ON o.order_id = i.order_id JOIN r_customers c ON o.customer_id = c.customer_id "
              "JOIN r_order_reviews r ON o.order_id = r.order_id"),
    ("rev", "SELECT g.*, p.price, coalesce(p.price, 0) / 1000 AS revenue FROM geoc g LEFT JOIN "
            "(SELECT customer_zip_code_prefix_3_digits AS k, sum(price) AS price FROM sales WHERE customer_zip_code_prefix_3_digits IS NOT NULL GROUP BY 1) p "
            "ON g.geolocation_zip_code_prefix_3_digits = p.k"),
    ("tick", "SELECT g.*, p.avg_ticket FROM geoc g LEFT JOIN (SELECT k, CAST(sum(pm) AS DOUBLE) / count(*) AS avg_ticket FROM "
             "(SELECT order_id, sum(CAST(price AS DECIMAL(18, 6))) AS pm, min(customer_zip_code_prefix_3_digits) AS k FROM sales GROUP BY order_id) "
             "WHERE k IS NOT NULL GROUP BY k) p ON g.geolocation_zip_code_prefix_3_digits = p.k"),
    ("frt", "SELECT g.*, p.freight_ratio FROM geoc g LEFT JOIN (SELECT k, avg(freight_value / price) AS freight_ratio FROM "
            "(SELECT order_id, sum(price) AS price, sum(freight_value) AS freight_value, min(customer_zip_code_prefix_3_digits) AS k "
            "FROM sales GROUP BY order_id) WHERE price > 0 AND k IS NOT NULL GROUP BY k) p ON g.geolocation_zip_code_prefix_3_digits = p.k"),
]


def geo_sql(final, extra=None):
    return with_ctes(GEO_CTES + (extra or []), final, roles=GEO_ROLES)


def loaded(spark, sf_dir):
    """Map points and sales lines, materialised once per input version (the
    two loaders the map view reuses for every selection)."""
    def build():
        r = Roles(spark, sf_dir)
        geo = materialize(gx.geo_points(r.geolocation()), "geo_points")
        sales = materialize(gx.sales_lines(r.orders(), r.order_items(), r.customers(), r.order_reviews())
                            .select("order_id", "price", "freight_value", "review_id", "customer_state",
                                    "customer_city", gx.CUST_PREFIX3), "sales_lines")
        return geo, sales
    return memo(spark, ("geo", fingerprint(sf_dir)), build)


def frames(spark, sf_dir, clip=True):
    geo, sales = loaded(spark, sf_dir)
    if clip:
        # whole-region clip: a function of the inputs only, computed once
        geo = memo(spark, ("geo_clipped", fingerprint(sf_dir)),
                   lambda: materialize(gx.clip_outliers(geo), "geo_clipped"))
    return geo, sales


@register("geo_prefixes", with_ctes([], "SELECT geolocation_zip_code_prefix, " + ", ".join(
    f"CAST(substr(geolocation_zip_code_prefix, 1, {n}) AS INTEGER) AS geolocation_zip_code_prefix_{n}_digits" for n in range(1, 5))
    + " FROM r_geolocation", roles=["r_geolocation"]))
def q_geo_prefixes(spark, sf_dir):
    g = gx.prefix_columns(Roles(spark, sf_dir).geolocation(), "geolocation_zip_code_prefix")
    return g.select("geolocation_zip_code_prefix", *[f"geolocation_zip_code_prefix_{n}_digits" for n in range(1, 5)])


@register("bounding_box", geo_sql("SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng FROM g0"))
def q_bounding_box(spark, sf_dir):
    return gx.in_bounding_box(Roles(spark, sf_dir).geolocation()).select(
        "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng")


@register("web_mercator", geo_sql("SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, round(x, 4) AS x, round(y, 4) AS y FROM geo"))
def q_web_mercator(spark, sf_dir):
    g = gx.geo_points(Roles(spark, sf_dir).geolocation())
    return g.select("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
                    F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@register("clip_outliers", geo_sql("SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng FROM geoc"))
def q_clip_outliers(spark, sf_dir):
    geo, _ = frames(spark, sf_dir)
    return geo.select("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng")


@register("filter_region", geo_sql(
    f"SELECT geolocation_zip_code_prefix, geolocation_city, round(coalesce(p.price, 0) / 1000, 6) AS revenue FROM "
    f"(SELECT * FROM geo WHERE geolocation_state = '{REGION_STATE}' AND lower(geolocation_city) = lower('{REGION_CITY}')) g "
    f"LEFT JOIN (SELECT customer_zip_code_prefix_3_digits AS k, sum(price) AS price FROM sales WHERE customer_state = '{REGION_STATE}' "
    f"AND lower(customer_city) = lower('{REGION_CITY}') AND customer_zip_code_prefix_3_digits IS NOT NULL GROUP BY 1) p "
    f"ON g.geolocation_zip_code_prefix_3_digits = p.k"))
def q_filter_region(spark, sf_dir):
    geo, sales = frames(spark, sf_dir, clip=False)
    g, s = gx.filter_region(geo, sales, REGION_STATE, REGION_CITY)
    return gx.geo_revenue(g, s).select("geolocation_zip_code_prefix", "geolocation_city",
                                       F.round("revenue", R6).alias("revenue"))


@register("sales_lines", geo_sql("SELECT order_id, review_id, round(price, 6) AS price, customer_zip_code_prefix_3_digits FROM sales"))
def q_sales_lines(spark, sf_dir):
    _, s = frames(spark, sf_dir, clip=False)
    return s.select("order_id", "review_id", F.round("price", R6).alias("price"), gx.CUST_PREFIX3)


@register("geo_revenue", geo_sql("SELECT geolocation_zip_code_prefix, geolocation_zip_code_prefix_3_digits, round(revenue, 6) AS revenue FROM rev"))
def q_geo_revenue(spark, sf_dir):
    geo, sales = frames(spark, sf_dir)
    return gx.geo_revenue(geo, sales).select("geolocation_zip_code_prefix", gx.PREFIX3,
                                             F.round("revenue", R6).alias("revenue"))


@register("geo_avg_ticket", geo_sql("SELECT geolocation_zip_code_prefix, geolocation_zip_code_prefix_3_digits, round(avg_ticket, 6) AS avg_ticket FROM tick"))
def q_geo_avg_ticket(spark, sf_dir):
    geo, sales = frames(spark, sf_dir)
    return gx.geo_avg_ticket(geo, sales).select("geolocation_zip_code_prefix", gx.PREFIX3,
                                                F.round("avg_ticket", R6).alias("avg_ticket"))


@register("geo_freight_ratio", geo_sql("SELECT geolocation_zip_code_prefix, geolocation_zip_code_prefix_3_digits, round(freight_ratio, 6) AS freight_ratio FROM frt"))
def q_geo_freight_ratio(spark, sf_dir):
    geo, sales = frames(spark, sf_dir)
    return gx.geo_freight_ratio(geo, sales).select("geolocation_zip_code_prefix", gx.PREFIX3,
                                                   F.round("freight_ratio", R6).alias("freight_ratio"))


@register("geo_headline", geo_sql(
    "SELECT (SELECT CAST(count(*) AS BIGINT) FROM rev) AS points, "
    "(SELECT round(CAST(sum(CAST(round(revenue * 1000000.0) AS BIGINT)) AS DOUBLE) / 1000000.0 * 1000000.0) / 1000000.0 FROM rev) AS revenue_total, "
    "(SELECT round(avg(avg_ticket), 6) FROM tick) AS mean_ticket, (SELECT round(avg(freight_ratio), 6) FROM frt) AS mean_freight_ratio"))
def q_geo_headline(spark, sf_dir):
    geo, sales = frames(spark, sf_dir)
    h = gx.geo_headline_of(gx.geo_metrics(geo, sales))
    return h.select("points", round_half_away("revenue_total").alias("revenue_total"),
                    *[F.round(c, R6).alias(c) for c in ("mean_ticket", "mean_freight_ratio")])


@register("raster_mean", geo_sql(
    "SELECT col, row, round(CAST(sum(CAST(round(revenue * 1000000.0) AS BIGINT)) AS DOUBLE) / count(revenue) / 1000000.0 * 1000000.0) / 1000000.0 AS mean, "
    "CAST(count(revenue) AS BIGINT) AS n FROM ("
    "SELECT revenue, CAST(CASE WHEN x1 = x0 THEN 0 ELSE least(floor((x - x0) / (x1 - x0) * 50), 49) END AS INTEGER) AS col, "
    "CAST(CASE WHEN y1 = y0 THEN 0 ELSE least(floor((y - y0) / (y1 - y0) * 25), 24) END AS INTEGER) AS row "
    "FROM rev, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM rev) e) GROUP BY col, row"))
def q_raster_mean(spark, sf_dir):
    geo, sales = frames(spark, sf_dir)
    # revenue is money in thousands (exact at 6 decimals): fixed-point mean
    r = gx.raster_mean(gx.geo_revenue(geo, sales), "x", "y", "revenue", 50, 25, exact_digits=6)
    return r.select("col", "row", round_half_away("mean").alias("mean"), "n")
