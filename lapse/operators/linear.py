"""Logistic regression whose fitted model is a table of coefficients.

``pyspark.ml`` finds the coefficients on sparse vectors that the tasks build
from codes (no label lists, no column metadata); the coefficients then become
a table (column, value, coefficient), and a row is scored by joining its
values to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lapse.operators.features import FEW_VALUES, Features, with_codes
from lapse.session import materialize, release, ship_by_value

_VECTORS = StructType().add("label", DoubleType()).add("weight", DoubleType()).add("features", VectorUDT())
COEFFICIENTS = "feature string, column string, value string, mean double, scale double, coefficient double"
INTERCEPT = "(intercept)"


def scaling(df: DataFrame, numeric: list[str]) -> list[tuple[float, float]]:
    """Mean and population deviation of each numeric column (1 for a constant one)."""
    row = df.agg(*[e for i, c in enumerate(numeric) for e in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    return [(float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 1.0) or 1.0) for i in range(len(numeric))]


def _vectors(df: DataFrame, f: Features, scales: list[tuple[float, float]], label: str, weight: str) -> DataFrame:
    """``label``, ``weight`` and sparse ``features``: scaled numbers (NULL: the mean), then 1 for each known value."""
    n, size = len(f.numeric), len(f.numeric) + sum(f.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n)
            codes = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            known = np.concatenate([np.ones(numbers.shape, bool), codes >= 0], axis=1)
            places = np.concatenate([np.broadcast_to(np.arange(n), numbers.shape), codes + n], axis=1)[known].astype(np.int32)
            values = np.concatenate([numbers, np.ones(codes.shape)], axis=1)[known]
            ends = pa.array(np.concatenate([[0], known.sum(axis=1).cumsum()]).astype(np.int32))
            vectors = pa.StructArray.from_arrays([pa.array(np.zeros(b.num_rows, np.int8)), pa.array(np.full(b.num_rows, size, np.int32)),
                                                  pa.ListArray.from_arrays(ends, pa.array(places)), pa.ListArray.from_arrays(ends, pa.array(values))],
                                                 names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vectors], names=["label", "weight", "features"])

    ship_by_value(__name__)
    numbers = F.array(*[F.coalesce((F.col(c).cast("double") - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, (m, s) in zip(f.numeric, scales)])
    codes = F.array(*[F.coalesce(F.col(f"{c}__code"), F.lit(-1).cast("long")) for c in f.categorical])
    coded = with_codes(df, f).select(F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"),
                                     numbers.cast("array<double>").alias("x"), codes.cast("array<long>").alias("c"))
    return coded.mapInArrow(run, _VECTORS)


def fit_logistic(df: DataFrame, f: Features, label: str, weight: str) -> DataFrame:
    """The stored coefficient table of the model that minimises sum w loss + |b|^2 / 2 (intercept free; weights that sum to n make this C = 1).

    One row a feature (``value`` NULL for numbers, with ``mean`` and ``scale``)
    and one for the intercept. The coefficients pass through the driver as one
    array of numbers; values are joined from the stored dictionary.
    """
    spark = df.sparkSession
    scales = scaling(df, f.numeric)
    data = materialize(_vectors(df, f, scales, label, weight), "logistic_vectors")
    total = data.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(labelCol="label", weightCol="weight", maxIter=1000, tol=1e-12, elasticNetParam=0.0, standardization=False,
                               regParam=1.0 / total, family="binomial").fit(data)
    release(data)
    found, n = model.coefficients.toArray(), len(f.numeric)
    rows = [(INTERCEPT, None, None, None, None, float(model.intercept))]
    rows += [(c, c, None, m, s, float(b)) for c, (m, s), b in zip(f.numeric, scales, found)]
    import pandas as pd
    codes = spark.createDataFrame(pd.DataFrame({"code": np.arange(len(found) - n), "coefficient": found[n:]}), "code long, coefficient double")
    values = codes.join(f.dictionary, "code").select(F.concat_ws("_", "column", "value").alias("feature"), "column", "value", F.lit(None).cast("double").alias("mean"),
                                                     F.lit(None).cast("double").alias("scale"), "coefficient")
    return materialize(spark.createDataFrame(rows, COEFFICIENTS).unionByName(values), "coefficients")


def _numeric_part(coefficients: DataFrame) -> Column:
    """Intercept and numbers: as many terms as there are numeric columns."""
    rows = coefficients.where("value IS NULL").collect()
    out = F.lit(sum(r["coefficient"] for r in rows if r["feature"] == INTERCEPT))
    for r in sorted((r for r in rows if r["feature"] != INTERCEPT), key=lambda r: r["column"]):
        out = out + F.coalesce((F.col(r["column"]).cast("double") - F.lit(r["mean"])) / F.lit(r["scale"]), F.lit(0.0)) * F.lit(r["coefficient"])
    return out


def score(df: DataFrame, coefficients: DataFrame, name: str = "score") -> DataFrame:
    """``df`` with the probability of class 1; values without a coefficient and NULLs add nothing."""
    columns = {r["column"]: r["n"] for r in coefficients.where("value IS NOT NULL").groupBy("column").agg(F.count("*").alias("n")).orderBy("column").collect()}
    keep, margin = df.columns, _numeric_part(coefficients)
    for c, n in columns.items():
        b = coefficients.where((F.col("column") == c) & F.col("value").isNotNull()).select(F.col("value").alias(f"{c}__v"), F.col("coefficient").alias(f"{c}__b"))
        b = F.broadcast(b) if n <= FEW_VALUES else b
        df = df.withColumn(f"{c}__v", F.col(c).cast("string")).join(b, f"{c}__v", "left")
        margin = margin + F.coalesce(f"{c}__b", F.lit(0.0))
    return df.select(*keep, (1 / (1 + F.exp(-margin))).alias(name))


def score_equations(df: DataFrame, coefficients: DataFrame, label: str, weight: str) -> DataFrame:
    """``feature``, ``n_rows`` (rows with the value; all for numbers) and ``residual``: |sum w (p - y) x + b| over the sum of weights, 0 at the optimum."""
    e = score(df, coefficients, "_p").withColumn("_e", F.col(weight) * (F.col("_p") - F.col(label)))
    tables = coefficients.select("feature", "column", "value", "mean", "scale", "coefficient")
    numbers = tables.where("value IS NULL").collect()
    x = {r["feature"]: F.lit(1.0) if r["feature"] == INTERCEPT else F.coalesce((F.col(r["column"]).cast("double") - F.lit(r["mean"])) / F.lit(r["scale"]), F.lit(0.0)) for r in numbers}
    cols = [r[0] for r in tables.where("value IS NOT NULL").select("column").distinct().collect()]
    parts = [F.struct(F.lit(r["feature"]).alias("feature"), (F.col("_e") * x[r["feature"]]).alias("e")) for r in numbers]
    parts += [F.struct(F.concat_ws("_", F.lit(c), F.col(c).cast("string")).alias("feature"), F.col("_e").alias("e")) for c in cols]
    sums = e.select(F.explode(F.array(*parts)).alias("s")).groupBy("s.feature").agg(F.count("*").alias("n_rows"), F.sum("s.e").alias("e"))
    total = e.agg(F.sum(weight).alias("w")).first()["w"]
    penalty = F.when(F.col("feature") == INTERCEPT, F.lit(0.0)).otherwise(F.col("coefficient"))
    return sums.join(tables.select("feature", "coefficient"), "feature").select("feature", "n_rows", (F.abs(F.col("e") + penalty) / F.lit(total)).alias("residual"))
