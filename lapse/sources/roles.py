"""Role views: the original e-commerce table shapes derived from the
driver's star-schema tables by integer arithmetic.

Each role is built lazily with the DataFrame API from parquet scans, so
filters and projections of a query reach the scan. The same derivations are
kept as SQL text (``ROLE_SQL``) for the DuckDB oracle, where they are inlined
as ``r_*`` CTEs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events")


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table; ``timestamp_ntz`` columns become session-zone
    ``timestamp`` so that epoch arithmetic is allowed."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    casts = {f.name: F.col(f.name).cast("timestamp")
             for f in df.schema.fields if isinstance(f.dataType, TimestampNTZType)}
    return df.withColumns(casts) if casts else df


def _hours(ts: str, expr: str):
    return F.expr(f"{ts} + make_dt_interval(0, CAST({expr} AS INT), 0, 0)")


def _zip_prefix(key: str):
    return F.lpad(((F.col(key) * 7919) % 100000).cast("string"), 5, "0")


class Roles:
    """Lazily built role DataFrames for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        return base_table(self.spark, self.sf_dir, name)

    def customers(self) -> DataFrame:
        c, n = self.base("customer"), self.base("nation")
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                .select(F.col("c_custkey").alias("customer_id"),
                        F.col("c_custkey").alias("customer_unique_id"),
                        F.lower("c_mktsegment").alias("customer_city"),
                        F.col("n_name").alias("customer_state"),
                        _zip_prefix("c_custkey").alias("customer_zip_code_prefix")))

    def orders(self) -> DataFrame:
        o = self.base("orders")
        k = F.col("o_orderkey")
        return o.select(
            k.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.when(k % 97 != 0, _hours("o_orderdate", "o_orderkey % 72")).alias("order_approved_at"),
            _hours("o_orderdate", "o_orderkey * 7 % 240").alias("order_delivered_carrier_date"),
            F.when(k % 50 != 0, _hours("o_orderdate", "o_orderkey * 13 % 720"))
             .alias("order_delivered_customer_date"),
            _hours("o_orderdate", "480").alias("order_estimated_delivery_date"))

    def order_items(self) -> DataFrame:
        li = self.base("lineitem")
        return li.select(F.col("l_orderkey").alias("order_id"),
                         F.col("l_partkey").alias("product_id"),
                         F.col("l_suppkey").alias("seller_id"),
                         F.col("l_extendedprice").alias("price"),
                         (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"))

    def order_payments(self) -> DataFrame:
        o = self.base("orders")
        k = F.col("o_orderkey")
        main = o.select(
            k.alias("order_id"),
            F.when(k % 4 == 0, "credit_card").when(k % 4 == 1, "boleto")
             .when(k % 4 == 2, "voucher").otherwise("debit_card").alias("payment_type"),
            (k % 12 + 1).alias("payment_installments"),
            F.col("o_totalprice").alias("payment_value"))
        extra = o.where(k % 10 == 0).select(
            k.alias("order_id"), F.lit("voucher").alias("payment_type"),
            F.lit(1).cast("bigint").alias("payment_installments"),
            F.lit(10.0).alias("payment_value"))
        return main.unionByName(extra)

    def order_reviews(self) -> DataFrame:
        o = self.base("orders")
        k = F.col("o_orderkey")
        main = o.where(k % 25 != 0).select(
            k.alias("review_id"), k.alias("order_id"),
            _hours("o_orderdate", "24 * (o_orderkey % 30)").alias("review_creation_date"),
            (k % 5 + 1).alias("review_score"))
        extra = o.where(k % 40 == 1).select(
            (k + 1000000000).alias("review_id"), k.alias("order_id"),
            _hours("o_orderdate", "720").alias("review_creation_date"),
            F.lit(5).cast("bigint").alias("review_score"))
        return main.unionByName(extra)

    def products(self) -> DataFrame:
        p = self.base("part")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_partkey") % 31 != 0, F.regexp_replace("p_name", " ", "_"))
             .alias("product_category_name"),
            (F.col("p_size") * 100).alias("product_weight_g"))

    def translation(self) -> DataFrame:
        p = self.base("part")
        name = F.regexp_replace("p_name", " ", "_")
        return p.select(name.alias("product_category_name"),
                        F.concat(F.lit(" "), F.upper(name), F.lit(" "))
                         .alias("product_category_name_english")).distinct()

    def sellers(self) -> DataFrame:
        s, n = self.base("supplier"), self.base("nation")
        return (s.join(n, s.s_nationkey == n.n_nationkey)
                .select(F.col("s_suppkey").alias("seller_id"),
                        F.lower("s_name").alias("seller_city"),
                        F.col("n_name").alias("seller_state")))

    def geolocation(self) -> DataFrame:
        c, n = self.base("customer"), self.base("nation")
        k = F.col("c_custkey")
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                .select(_zip_prefix("c_custkey").alias("geolocation_zip_code_prefix"),
                        (F.lit(-34) + (k * 104729 % 4500).cast("double") / 100).alias("geolocation_lat"),
                        (F.lit(-75) + (k * 15485863 % 4300).cast("double") / 100).alias("geolocation_lng"),
                        F.lower("c_mktsegment").alias("geolocation_city"),
                        F.col("n_name").alias("geolocation_state")))

    def tables(self) -> dict[str, DataFrame]:
        """All nine roles, keyed by the original table names."""
        return {
            "customers": self.customers(), "orders": self.orders(),
            "orders_items": self.order_items(), "order_payments": self.order_payments(),
            "order_reviews": self.order_reviews(), "products": self.products(),
            "product_category_name_translation": self.translation(),
            "sellers": self.sellers(), "geolocation": self.geolocation(),
        }


# Role derivations as SQL, runnable unchanged by DuckDB.
ROLE_SQL = {
    "r_customers": "SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, lower(c_mktsegment) AS customer_city, n_name AS customer_state, lpad(CAST((c_custkey * 7919) % 100000 AS VARCHAR(9)), 5, '0') AS customer_zip_code_prefix FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "r_orders": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status, o_orderdate AS order_purchase_timestamp, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 72) END AS order_approved_at, o_orderdate + INTERVAL '1' HOUR * (o_orderkey * 7 % 240) AS order_delivered_carrier_date, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate + INTERVAL '1' HOUR * (o_orderkey * 13 % 720) END AS order_delivered_customer_date, o_orderdate + INTERVAL '1' HOUR * 480 AS order_estimated_delivery_date FROM orders",
    "r_order_items": "SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id, l_extendedprice AS price, l_extendedprice * l_tax AS freight_value FROM lineitem",
    "r_order_payments": "SELECT o_orderkey AS order_id, CASE o_orderkey % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto' WHEN 2 THEN 'voucher' ELSE 'debit_card' END AS payment_type, o_orderkey % 12 + 1 AS payment_installments, o_totalprice AS payment_value FROM orders UNION ALL SELECT o_orderkey, 'voucher', CAST(1 AS BIGINT), CAST(10 AS DOUBLE) FROM orders WHERE o_orderkey % 10 = 0",
    "r_order_reviews": "SELECT o_orderkey AS review_id, o_orderkey AS order_id, o_orderdate + INTERVAL '1' HOUR * (24 * (o_orderkey % 30)) AS review_creation_date, o_orderkey % 5 + 1 AS review_score FROM orders WHERE o_orderkey % 25 <> 0 UNION ALL SELECT o_orderkey + 1000000000, o_orderkey, o_orderdate + INTERVAL '1' HOUR * 720, CAST(5 AS BIGINT) FROM orders WHERE o_orderkey % 40 = 1",
    "r_products": "SELECT p_partkey AS product_id, CASE WHEN p_partkey % 31 <> 0 THEN replace(p_name, ' ', '_') END AS product_category_name, p_size * 100 AS product_weight_g FROM part",
    "r_translation": "SELECT DISTINCT replace(p_name, ' ', '_') AS product_category_name, concat(' ', upper(replace(p_name, ' ', '_')), ' ') AS product_category_name_english FROM part",
    "r_sellers": "SELECT s_suppkey AS seller_id, lower(s_name) AS seller_city, n_name AS seller_state FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "r_geolocation": "SELECT lpad(CAST((c_custkey * 7919) % 100000 AS VARCHAR(9)), 5, '0') AS geolocation_zip_code_prefix, -34 + CAST(c_custkey * 104729 % 4500 AS DOUBLE) / 100 AS geolocation_lat, -75 + CAST(c_custkey * 15485863 % 4300 AS DOUBLE) / 100 AS geolocation_lng, lower(c_mktsegment) AS geolocation_city, n_name AS geolocation_state FROM customer JOIN nation ON c_nationkey = n_nationkey",
}
