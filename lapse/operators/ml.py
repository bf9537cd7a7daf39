"""Churn models as tables.

Settings follow the reference's four learners: logistic regression with
balanced class weights and C = 1; a depth-5 tree with at least 50 rows per
leaf; a 100-tree depth-7 forest with 30 per leaf and about sqrt(features)
drawn per node; boosting (150 rounds, depth 5, step 0.1, 80 % of rows and
features per tree, L2 1) weighted by n0/n1 on the positive class. A fitted
model is a stored table: coefficients (:mod:`lapse.operators.linear`) or nodes
(:mod:`lapse.operators.trees`). Trees split numbers at 31 exact quantiles, and
draw rows and features by hash, so shares are met on average, not to the row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.operators import features, linear, split, trees
from lapse.operators.metrics import classification_metrics, roc_auc
from lapse.session import materialize, with_scalars

# Model features (the app adds RFM_Score to the numeric list).
NUMERIC_FEATURES = ["payment_value", "review_score", "price", "product_weight_g", "approval_delay"]
NUMERIC_FEATURES_APP = NUMERIC_FEATURES + ["RFM_Score"]
CATEGORICAL_FEATURES = ["customer_city", "customer_state", "order_status", "payment_type",
                        "payment_installments", "seller_city", "seller_state", "product_category_name"]
LABEL = "is_churned"
SEED = 42


def stratified_split(df: DataFrame, label: str = LABEL, test_fraction: float = 0.3, seed: int = SEED,
                     key: list[str] | None = None) -> DataFrame:
    """Mark rows ``is_test`` so that each class has round(fraction x n_c) test
    rows (J15, T23), in the order of a seeded md5 of ``key`` (all columns by
    default); see :mod:`lapse.operators.split`."""
    return split.stratified_split(df, label, test_fraction, seed, key)


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weights n / (k x n_c) per class and the positive-class
    weight n0 / n1 (J16); one row per class."""
    c = df.groupBy(label).agg(F.count("*").alias("n_c"))
    tot = c.agg(F.sum("n_c").alias("_n"), F.count("*").alias("_k"),
                F.sum(F.when(F.col(label) == 0, F.col("n_c"))).alias("_n0"),
                F.sum(F.when(F.col(label) == 1, F.col("n_c"))).alias("_n1"))
    return (with_scalars(c, tot)
            .select(label, "n_c", (F.col("_n") / (F.col("_k") * F.col("n_c"))).alias("balanced_weight"),
                    (F.col("_n0") / F.col("_n1")).alias("pos_weight")))


def with_weights(df: DataFrame, label: str = LABEL, kind: str = "balanced") -> DataFrame:
    """Attach a ``weight`` column: balanced per class, or 1 / pos-weight for
    the boosted model (positives get n0/n1). The class table has one row per
    class; AQE broadcasts it by its size."""
    w = class_weights(df, label)
    if kind == "balanced":
        w = w.select(label, F.col("balanced_weight").alias("weight"))
    else:
        w = w.select(label, F.when(F.col(label) == 1, F.col("pos_weight")).otherwise(F.lit(1.0)).alias("weight"))
    return df.join(w, label)


@dataclass
class Model:
    """A fitted learner: its kind and its table of coefficients or nodes."""

    kind: str
    table: DataFrame


SETTINGS = {"tree": trees.TREE, "forest": trees.FOREST, "boosted": trees.BOOSTED}


def fit(train: DataFrame, kind: str, numeric: list[str] = NUMERIC_FEATURES,
        categorical: list[str] = CATEGORICAL_FEATURES, label: str = LABEL, settings: trees.Params | None = None) -> Model:
    """Fit features (:mod:`lapse.operators.features`) and learner (J17-J22). ``settings`` replaces a tree learner's."""
    if kind != "logistic" and kind not in SETTINGS:
        raise ValueError(kind)
    weighted = with_weights(train.select(label, *numeric, *categorical), label, "pos" if kind == "boosted" else "balanced")
    data = materialize(weighted, "train")  # the learners pass over these rows many times
    if kind == "logistic":  # reads numbers as they are, no interval of them
        return Model(kind, linear.fit_logistic(data, features.learn(data, numeric, categorical, intervals=1), label, "weight"))
    return Model(kind, trees.grow(data, features.learn(data, numeric, categorical), label, "weight", settings or SETTINGS[kind]))


def score(model: Model, df: DataFrame) -> DataFrame:
    """Add ``score`` (probability of class 1) and ``prediction`` (1 above one half) by the model's table."""
    out = linear.score(df, model.table) if model.kind == "logistic" else trees.score(df, model.table, SETTINGS[model.kind])
    return out.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def feature_importance(model: Model, n: int = 20) -> DataFrame:
    """The ``n`` most important features of a tree model (J28), names joined from the table."""
    return trees.importance(model.table, SETTINGS[model.kind]).orderBy(F.desc("importance"), "feature").limit(n)


def save(model: Model, path: str) -> None:
    """Store a model under ``path`` (A12): its table as Parquet and its kind."""
    model.table.write.mode("overwrite").parquet(f"{path}/table")
    model.table.sparkSession.createDataFrame([(json.dumps({"kind": model.kind}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/kind")


def load(spark: SparkSession, path: str) -> Model:
    """A model that :func:`save` stored."""
    return Model(json.loads(spark.read.text(f"{path}/kind").first()[0])["kind"], spark.read.parquet(f"{path}/table"))


def evaluate(scored: DataFrame, label: str = LABEL) -> DataFrame:
    """Metrics row of a scored frame: J24 metrics plus ROC-AUC. Scores are read several times, so they are stored first."""
    s = materialize(scored.select(F.col(label).cast("int").alias("label"), "score", "prediction"), "scored")
    return with_scalars(classification_metrics(s), roc_auc(s, "label", "score"))


def compare(models: dict[str, Model], test: DataFrame, label: str = LABEL) -> DataFrame:
    """One row of metrics a model on ``test``, best AUC first."""
    rows = None
    for name, m in models.items():
        e = evaluate(score(m, test), label).withColumn("model", F.lit(name))
        e = test.sparkSession.createDataFrame([e.first()], e.schema)  # one metrics row per model
        rows = e if rows is None else rows.unionByName(e)
    return rows.orderBy(F.desc("roc_auc"))


def compare_models(df: DataFrame, kinds=("logistic", "tree", "forest", "boosted"),
                   numeric: list[str] = NUMERIC_FEATURES, label: str = LABEL) -> DataFrame:
    """Train each model on the 70 % split and :func:`compare` them on the 30 %."""
    both = materialize(stratified_split(df, label), "split")
    train, test = both.where(~F.col("is_test")).drop("is_test"), both.where(F.col("is_test")).drop("is_test")
    return compare({k: fit(train, k, numeric) for k in kinds}, test, label)


def score_customers(model: Model, df: DataFrame, customer: str = "customer_unique_id",
                    order_by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Churn probability and risk label for every customer's first row
    under an explicit order (J30, batch form of the one-customer view), with
    the record's columns ``keep``.

    The first row is a ``min`` over a struct led by the ordering columns:
    a partial aggregate, so a customer with many rows is reduced on the map
    side instead of being sorted in one task."""
    order_by = order_by or [c for c in df.columns if c != customer]
    rest = [c for c in df.columns if c != customer and c not in order_by]
    first = (df.groupBy(customer).agg(F.min(F.struct(*order_by, *rest)).alias("_r"))
             .select(customer, *[F.col(f"_r.{c}").alias(c) for c in order_by + rest]))
    s = score(model, first)
    return s.select(customer, *(keep or []), "score", "prediction",
                    F.when(F.col("prediction") == 1, "high").otherwise("low").alias("risk"))
