"""Plans that the design relies on: hot keys are split, null filters make joins inner."""

from pyspark.sql import functions as F

from lapse.operators import clean
from lapse.operators import lifecycle as lc
from lapse.plans import fact as fx

SKEW = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k"}


def final_plan(spark, df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def with_conf(spark, fn):
    old = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_customer_is_split(spark):
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 5000).alias("customer_unique_id"),
                               F.col("id").alias("order_id"), F.xxhash64("id").alias("x"))

    def run():
        out = lc.with_order_count(df)
        assert out.where("customer_unique_id = 7").select("quantity").first()[0] >= n // 2
        return final_plan(spark, out)
    assert "skew=true" in with_conf(spark, run)


def test_hot_product_is_split(spark):
    n = 200_000
    items = spark.range(n).select(F.col("id").alias("order_id"), (F.col("id") % 50).alias("seller_id"),
                                  F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 3000).alias("product_id"),
                                  F.rand(1).alias("price"))
    products = spark.range(4000).select(F.col("id").alias("product_id"), F.lit("c").alias("product_category_name"))
    sellers = spark.range(50).select(F.col("id").alias("seller_id"), F.lit("a").alias("seller_city"), F.lit("b").alias("seller_state"))

    def run():
        out = fx.product_items(products, items, sellers)
        assert out.where("order_id IS NULL").count() == 4000 - out.where("order_id IS NOT NULL").select("product_id").distinct().count()
        return final_plan(spark, fx.product_items(products, items, sellers, keep_unsold=False))
    assert "skew=true" in with_conf(spark, run)


def test_null_filter_makes_the_joins_inner(spark):
    a = spark.range(10).withColumn("x", F.col("id"))
    b, c = a.withColumnRenamed("x", "y"), a.withColumnRenamed("x", "z")
    out = clean.drop_incomplete(a.join(b, "id", "left").join(c, "id", "left"), ["y", "z"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and plan.count("Join Inner") == 2


def test_partitions_grow_with_the_input_of_the_fact(spark, tmp_path, monkeypatch):
    """Few partitions set for a large input are raised before the fact is built, never lowered."""
    from lapse.plans import fact_queries, memo
    (tmp_path / "orders.parquet").write_bytes(b"x" * (90 << 20))
    (tmp_path / "lineitem.parquet").write_bytes(b"x" * (30 << 20))
    seen = []
    monkeypatch.setattr(fact_queries.fx, "order_fact", lambda *_: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    monkeypatch.setattr(fact_queries, "Roles", lambda *_: type("R", (), {"tables": lambda self: {}})())
    monkeypatch.setattr(memo, "_MEMO", {})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        fact_queries.fact_parts(spark, str(tmp_path))
        spark.conf.set("spark.sql.shuffle.partitions", "77")
        fact_queries.fact_parts(spark, str(tmp_path), "app")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [30, 77]


def _tables(spark):
    """Orders 1 (kept, in two equal rows), 2 (delivered before it was approved), 3 (kept, no payment) and 4 (kept); repeated items and payments."""
    from datetime import datetime, timedelta
    at = [datetime(2020, 1, 1) + timedelta(days=d) for d in range(9)]
    whole = [at[0], at[1], at[2], at[3], at[8]]
    orders = [(1, 10, "F", *whole), (1, 10, "F", *whole), (2, 10, "F", at[0], at[4], at[2], at[3], at[8]), (3, 11, "F", *whole), (4, 11, "O", *whole)]
    times = "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"
    make = spark.createDataFrame
    return {
        "orders": make(orders, "order_id long, customer_id long, order_status string, " + ", ".join(f"{t} timestamp" for t in times)),
        "customers": make([(10, 10, "a", "X"), (11, 11, "b", "Y")], "customer_id long, customer_unique_id long, customer_city string, customer_state string"),
        "order_reviews": make([(n, n, at[5], 5) for n in (1, 2, 3, 4)] + [(9, 1, at[6], 3)], "review_id long, order_id long, review_creation_date timestamp, review_score long"),
        "orders_items": make([(1, 7, 70, 2.0, 0.1), (1, 7, 70, 2.0, 0.2), (1, 8, 71, 3.0, 0.1), (2, 7, 70, 2.0, 0.1), (3, 7, 70, 2.0, 0.1), (4, 8, 72, 5.0, 0.1), (None, 8, 70, 1.0, 0.1)],
                             "order_id long, product_id long, seller_id long, price double, freight_value double"),
        "order_payments": make([(1, "card", 1, 5.0), (1, "card", 1, 5.0), (1, "voucher", 1, 1.0), (2, "card", 1, 2.0), (4, "card", 1, 5.0)],
                               "order_id long, payment_type string, payment_installments long, payment_value double"),
        "products": make([(7, "p", 100), (8, "p", 200)], "product_id long, product_category_name string, product_weight_g long"),
        "product_category_name_translation": make([("p", "P")], "product_category_name string, product_category_name_english string"),
        "sellers": make([(70, "c", "X"), (71, "d", "Y")], "seller_id long, seller_city string, seller_state string"),
    }


def test_items_of_orders_that_the_fact_drops_go_no_further(spark, monkeypatch):
    """Products and sellers meet only the items of kept orders; the fact holds each review x distinct item x distinct payment once."""
    seen, joined = [], fx.product_items

    def spy(products, items, *rest, **named):
        seen.append({r.order_id for r in items.select("order_id").collect()})
        return joined(products, items, *rest, **named)
    monkeypatch.setattr(fx, "product_items", spy)
    parts = fx.order_fact(_tables(spark))
    assert seen == [{1, 3, 4}]
    got = sorted((r.order_id, r.review_id, r.product_id, r.seller_city or "", r.payment_type, r.quantity, r.price) for r in parts.fact.collect())
    assert got == sorted([(1, v, p, c, t, 2, x) for v in (1, 9) for p, c, x in ((7, "c", 2.0), (8, "d", 3.0)) for t in ("card", "voucher")]
                         + [(4, 4, 8, "", "card", 2, 5.0)])
    assert sorted((r.order_id, r.quantity) for r in parts.merge1.collect()) == [(1, 2)] * 4 + [(2, 2), (3, 2), (4, 2)]


def test_inputs_of_the_fact_are_dealt_by_order_once(spark, monkeypatch):
    """Without broadcasts: one shuffle each for items, labelled orders and payments on the way to the order joins, none to find equal rows."""
    plans = []

    def stored(df, name=None, mode="table", codec=None):
        if name == "order_fact":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()
    monkeypatch.setattr(fx, "materialize", stored)
    monkeypatch.setattr(fx, "broadcast_if_few", lambda df: df)
    with_conf(spark, lambda: fx.order_fact(_tables(spark)))
    shuffled = [line.split("hashpartitioning(")[1] for line in plans[0].splitlines() if "Exchange hashpartitioning(" in line]
    several = [s for s in shuffled if "price#" in s or "payment_value#" in s or "review_score#" in s]
    assert shuffled and not several


def test_few_sellers_are_broadcast_and_many_are_not(spark):
    from lapse.session import broadcast_if_few
    left, right = spark.range(100), spark.range(20)
    plan = {n: with_conf(spark, lambda n=n: left.join(broadcast_if_few(right, n), "id")._jdf.queryExecution().sparkPlan().toString()) for n in (20, 19)}
    assert "BroadcastHashJoin" in plan[20] and "BroadcastHashJoin" not in plan[19]


def test_a_query_that_reads_the_model_input_once_stores_and_shuffles_its_columns_only(spark, monkeypatch):
    from lapse.plans import memo, report_queries
    fact = spark.range(40).select(*[(F.col("id") % 5).alias(c) if c == "customer_unique_id" else F.when(F.col("id") % 11 != i, F.col("id") % 3).alias(c)
                                    for i, c in enumerate(report_queries.MI_COLS) if c != "RFM_Score"])
    rfm = spark.range(4).select(F.col("id").alias("customer_unique_id"), F.lit(7).alias("RFM_Score"))
    stored = []
    monkeypatch.setattr(memo, "_MEMO", {})
    monkeypatch.setattr(report_queries, "rfm_frames", lambda *_: (type("P", (), {"fact": fact}), rfm))
    monkeypatch.setattr(report_queries, "materialize", lambda df, *_, **__: stored.append(df) or df)
    monkeypatch.setattr(report_queries, "fingerprint", lambda _: ())
    cols = ["customer_state", "is_churned"]
    once = sorted(tuple(r) for r in report_queries.app_model_input(spark, "x", cols).collect())
    assert not stored and once
    whole = report_queries.app_model_input(spark, "x")
    assert stored and once == sorted(tuple(r) for r in whole.select(*cols).collect())
    assert once == sorted(tuple(r) for r in report_queries.app_model_input(spark, "x", cols).collect()) and len(stored) == 1
