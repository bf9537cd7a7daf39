"""Reading, schema checks and persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField,
                               StructType, TimestampType)

from lapse.session import materialize  # noqa: F401  (A11, re-exported)

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Leftover index columns of a CSV written with its row index: pandas names
# the blank header "Unnamed: 0", Spark "_c0".
INDEX_COLUMNS = ("Unnamed: 0", "_c0", "")


def _schema(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, L, D, T = StringType(), LongType(), DoubleType(), TimestampType()

# Schemas of the original CSV tables (columns the code names). Timestamps are
# read as text and parsed by :func:`parse_ts`, so the strict/lenient choice
# stays explicit. Zip code prefixes are text (leading zeros).
SCHEMAS = {
    "customers": _schema(("customer_id", S), ("customer_unique_id", S),
                         ("customer_zip_code_prefix", S), ("customer_city", S), ("customer_state", S)),
    "geolocation": _schema(("geolocation_zip_code_prefix", S), ("geolocation_lat", D),
                           ("geolocation_lng", D), ("geolocation_city", S), ("geolocation_state", S)),
    "order_payments": _schema(("order_id", S), ("payment_sequential", L), ("payment_type", S),
                              ("payment_installments", L), ("payment_value", D)),
    "order_reviews": _schema(("review_id", S), ("order_id", S), ("review_score", L),
                             ("review_comment_title", S), ("review_comment_message", S),
                             ("review_creation_date", S), ("review_answer_timestamp", S)),
    "orders": _schema(("order_id", S), ("customer_id", S), ("order_status", S),
                      ("order_purchase_timestamp", S), ("order_approved_at", S),
                      ("order_delivered_carrier_date", S), ("order_delivered_customer_date", S),
                      ("order_estimated_delivery_date", S)),
    "product_category_name_translation": _schema(("product_category_name", S),
                                                 ("product_category_name_english", S)),
    "products": _schema(("product_id", S), ("product_category_name", S), ("product_name_lenght", D),
                        ("product_description_lenght", D), ("product_photos_qty", D), ("product_weight_g", D),
                        ("product_length_cm", D), ("product_height_cm", D), ("product_width_cm", D)),
    "sellers": _schema(("seller_id", S), ("seller_zip_code_prefix", S), ("seller_city", S),
                       ("seller_state", S)),
    "orders_items": _schema(("order_id", S), ("order_item_id", L), ("product_id", S),
                            ("seller_id", S), ("shipping_limit_date", S), ("price", D),
                            ("freight_value", D), ("shipping_limit_date.1", S)),
}

ORDER_TS_COLUMNS = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
                    "order_delivered_customer_date", "order_estimated_delivery_date"]


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str = "csv") -> DataFrame:
    """Read a table with a header (A1). With a given schema every column is
    found by its name in the header and cast, whatever the order of the
    columns and with or without a leading index column; a column that the
    file lacks is NULL, one that the schema lacks is left out. No inference
    pass, and zip columns stay text (A3). Values that do not cast are NULL."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if isinstance(schema, str):
        schema = SCHEMAS[schema]
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return drop_index_column(r.option("inferSchema", True).csv(path))
    text = r.csv(path)  # all text, named by the header
    return text.select(*[(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in text.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                         for f in schema.fields if f.name not in INDEX_COLUMNS])


def drop_index_column(df: DataFrame) -> DataFrame:
    """Drop a leftover index column if present (A2); no-op otherwise."""
    present = [c for c in INDEX_COLUMNS if c in df.columns]
    return df.drop(*present) if present else df


def parse_ts(df: DataFrame, cols: list[str], mode: str = "strict",
             fmt: str = TS_FORMAT) -> DataFrame:
    """Parse text columns as timestamps.

    ``strict`` fails the job on an unparsable value (ANSI ``to_timestamp``);
    ``coerce`` turns it into NULL (``try_to_timestamp``). Columns that are
    already timestamps are cast to the session zone only.
    """
    if mode not in ("strict", "coerce"):
        raise ValueError(mode)
    out = {}
    types = dict(df.dtypes)
    for c in cols:
        if types.get(c) in ("timestamp", "timestamp_ntz", "date"):
            out[c] = F.col(c).cast("timestamp")
        elif mode == "strict":
            out[c] = F.when(F.col(c).isNull(), F.lit(None).cast("timestamp")).otherwise(
                F.coalesce(F.try_to_timestamp(F.col(c), F.lit(fmt)),
                           F.raise_error(F.concat(F.lit(f"unparsable timestamp in {c}: "), F.col(c)))))
        else:
            out[c] = F.try_to_timestamp(F.col(c), F.lit(fmt))
    return df.withColumns(out)


def describe_schema(df: DataFrame) -> DataFrame:
    """Columns and their types as rows (A5); built from the schema, no job."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Raise if any column is missing (A6); returns ``df`` for chaining."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def save_model(model, path: str) -> None:
    """Persist a fitted ``pyspark.ml`` model / pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a fitted pipeline saved by :func:`save_model`."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
