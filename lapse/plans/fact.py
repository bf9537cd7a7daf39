"""The order fact (G3) and the model input.

Two presets reproduce the two reference programs:

* ``notebook``: reviews keep ``review_id``; products with *any* NULL are
  dropped; order items with any NULL are dropped; unparsable dates fail.
* ``app``: reviews without ``review_id`` (more rows collapse as
  duplicates); only products without a category are dropped; unparsable
  dates become NULL.

Plan notes: the reference removes duplicates after its key joins. For
equi/left joins on a key, distinct(A ⟕ B ⟕ C) = distinct(A) ⟕ distinct(B) ⟕
distinct(C) (an output row is its input rows side by side), so each input is
deduplicated first, on its own narrower rows, and the fanned-out fact is
never shuffled for a duplicate check. Items, payments and labelled orders are
dealt by ``order_id`` once and deduplicated there (equal rows have equal
orders); items are dealt together with the orders that the fact keeps, so
that only their items go on to products and sellers. Customer columns
(order count, labels) are joined to one another first and reach the orders in
one join. Sellers, counted first, are broadcast while few; the other dimension
joins carry no hint: they grow with the data, so AQE decides from measured sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lapse.functions.text import CATEGORY_CORRECTIONS, correct_labels, normalize_label
from lapse.functions.time import elapsed_days, elapsed_seconds
from lapse.operators import clean
from lapse.operators import lifecycle as lc
from lapse.session import broadcast_if_few, materialize
from lapse.sources.tables import ORDER_TS_COLUMNS, parse_ts

# Columns carried from the label table onto orders.
LABEL_COLUMNS = ["is_churned", "days_since_last_order", "median_interval_days"]

# The model input (id, 17 features, label).
MODEL_INPUT_COLUMNS = [
    "customer_unique_id", "customer_city", "customer_state", "order_status", "payment_type",
    "payment_installments", "payment_value", "review_score", "price", "product_weight_g",
    "seller_city", "seller_state", "product_category_name", "approval_delay",
    "delivery_time_to_customer_days", "estimated_delivery_time", "delivery_delay",
    "RFM_Score", "is_churned",
]


@dataclass(frozen=True)
class Preset:
    review_columns: tuple[str, ...]
    product_null_subset: tuple[str, ...] | None   # None = any column
    drop_incomplete_items: bool
    date_mode: str


PRESETS = {
    "notebook": Preset(("review_id", "order_id", "review_creation_date", "review_score"),
                       None, True, "strict"),
    "app": Preset(("order_id", "review_creation_date", "review_score"),
                  ("product_category_name",), False, "coerce"),
}


def orders_with_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """orders ⋈ customers on customer_id, which is then dropped."""
    cust = customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state")
    return orders.join(cust, "customer_id", "inner").drop("customer_id")


def with_reviews(orders: DataFrame, reviews: DataFrame, columns=PRESETS["notebook"].review_columns) -> DataFrame:
    """orders ⟕ reviews on order_id (D2); one row per review."""
    return orders.join(reviews.select(*columns), "order_id", "left")


def translate_categories(products: DataFrame, translation: DataFrame,
                         corrections: dict[str, str] | None = None) -> DataFrame:
    """Replace the category by its normalised English name, then apply the
    corrections (D5, B9, B10)."""
    t = translation.select("product_category_name", "product_category_name_english")
    out = (products.join(t, "product_category_name", "left")
           .drop("product_category_name")
           .withColumn("product_category_name",
                       correct_labels(normalize_label("product_category_name_english"),
                                      CATEGORY_CORRECTIONS if corrections is None else corrections))
           .drop("product_category_name_english"))
    return out


def product_items(products: DataFrame, items: DataFrame, sellers: DataFrame, keep_unsold: bool = True) -> DataFrame:
    """products ⟕ items on product_id, duplicates removed, ⟕ sellers.

    Deduplicating both sides before the join gives the same rows as
    deduplicating the joined rows (see module notes). The large side leads an
    inner join, which AQE may split on a hot product or broadcast from the
    products; products without any item (``keep_unsold``) are added by an
    anti join. They have a NULL ``order_id`` and can meet no order downstream.
    """
    it = items.select("order_id", "seller_id", "product_id", "price").dropDuplicates()
    prod = products.dropDuplicates()
    m2 = it.join(prod, "product_id")
    if keep_unsold:
        unsold = prod.join(it.select("product_id"), "product_id", "left_anti")
        m2 = m2.unionByName(unsold, allowMissingColumns=True)
    m2 = m2.select("product_id", *[c for c in prod.columns if c != "product_id"], *[c for c in it.columns if c != "product_id"])
    sold_by = sellers.select("seller_id", "seller_city", "seller_state").dropDuplicates()
    return m2.join(broadcast_if_few(sold_by), "seller_id", "left")


def delivery_metrics(df: DataFrame) -> DataFrame:
    """Approval delay (s), delivery time, delay vs estimate and estimated
    time (floored days) in one projection (B6)."""
    return df.withColumns({
        "approval_delay": elapsed_seconds("order_approved_at", "order_purchase_timestamp"),
        "delivery_time_to_customer_days": elapsed_days("order_delivered_customer_date",
                                                       "order_purchase_timestamp"),
        "delivery_delay": elapsed_days("order_delivered_customer_date", "order_estimated_delivery_date"),
        "estimated_delivery_time": elapsed_days("order_estimated_delivery_date",
                                                "order_purchase_timestamp"),
    })


@dataclass
class FactParts:
    base: DataFrame         # orders x customers x reviews, complete rows
    merge1: DataFrame       # base + quantity
    labels: DataFrame       # per-customer features and is_churned
    orders_labeled: DataFrame  # merge1 + label columns
    fact: DataFrame         # the order-item-payment fact with delivery metrics


def order_fact(tables: dict[str, DataFrame], preset: str = "notebook",
               multiplier: float = 2.0, materialize_mode: str | None = "table") -> FactParts:
    """Build the order fact from the nine tables.

    The order base is read by every label aggregate and by the fact, the
    customers' columns by both order tables, and the fact by every report, so they are materialised
    (``materialize_mode``: 'table' writes to the shared checkpoint folder,
    'checkpoint' / 'cache' as in :func:`lapse.session.materialize`, None keeps
    one lazy plan).
    """
    p = PRESETS[preset]
    orders = parse_ts(tables["orders"], ORDER_TS_COLUMNS, p.date_mode)
    reviews = parse_ts(tables["order_reviews"], ["review_creation_date"], p.date_mode)
    o = orders_with_customers(orders, tables["customers"])
    base = clean.drop_incomplete(with_reviews(o, reviews, p.review_columns))
    if materialize_mode:
        base = materialize(base, "orders_base", materialize_mode, "zstd")
    labels = lc.churn_labels(base, multiplier=multiplier)
    # every customer of the base is among the orders, so the count is never NULL and drops no row
    per = lc.attach_customer(labels.select(lc.CUSTOMER, *LABEL_COLUMNS), lc.order_counts(o))
    if materialize_mode:
        per = materialize(per, "customer_columns", materialize_mode)
    merge1 = lc.attach_customer(base, per, columns=["quantity"])
    labeled = lc.attach_customer(base, per, columns=["quantity", *LABEL_COLUMNS])

    products = translate_categories(tables["products"], tables["product_category_name_translation"])
    products = clean.drop_incomplete(products, list(p.product_null_subset) if p.product_null_subset else None)
    items = tables["orders_items"]
    if p.drop_incomplete_items:
        items = clean.drop_incomplete(items)
    kept = clean.valid_event_order(base).select("order_id").distinct()
    items = items.select("order_id", "seller_id", "product_id", "price").join(kept, "order_id", "left_semi")
    m3 = product_items(products, items, tables["sellers"], keep_unsold=False)  # a row without an order meets none

    pay = (tables["order_payments"].select("order_id", "payment_type", "payment_installments", "payment_value")
           .repartition("order_id").dropDuplicates())
    m5 = (clean.valid_event_order(labeled).repartition("order_id").dropDuplicates()
          .join(m3, "order_id", "left")
          .join(pay, "order_id", "left"))
    m5 = clean.drop_incomplete(m5, ["product_id", "payment_type"])
    fact = delivery_metrics(m5)
    if materialize_mode:
        fact = materialize(fact, "order_fact", materialize_mode, "zstd")
    return FactParts(base, merge1, labels, labeled, fact)


def model_input(fact: DataFrame, rfm: DataFrame, columns: list[str] | None = None,
                drop_null: bool = True) -> DataFrame:
    """Attach RFM columns to the fact and keep the model columns."""
    cols = columns or MODEL_INPUT_COLUMNS
    keep = [c for c in ("Frequency", "MonetaryValue", "Recency", "R", "F", "M", "RFM_Score",
                        "RFM_Segment", "Cluster") if c in rfm.columns]
    df = fact.join(rfm.select("customer_unique_id", *keep), "customer_unique_id", "left")
    df = df.select(*cols)
    return clean.drop_incomplete(df, cols) if drop_null else df
