"""Classification metrics on a scored frame.

All are aggregations; ROC quantities need a global order over scores, which
goes through :mod:`lapse.operators.ordered` (distinct scores, bucketed
prefix sums), never a single-task window over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions.util import safe_div
from lapse.operators.ordered import running_sums
from lapse.session import with_scalars


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """tp, tn, fp, fn in one conditional aggregation."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    return df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
                  F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Specificity, sensitivity, precision, F1, accuracy and the counts
    (J24); every ratio with a zero denominator is 0.0 (T28)."""
    c = confusion(df, label, pred)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, tp + fn)
    return c.select(
        safe_div(tn, tn + fp).alias("specificity"), rec.alias("sensitivity"), prec.alias("precision"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        "tp", "tn", "fp", "fn")


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class: precision, recall, F1 and support."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    per_true = df.groupBy(y.alias("class")).agg(F.count("*").alias("support"),
                                               F.count_if(y == p).alias("hit"))
    per_pred = df.groupBy(p.alias("class")).agg(F.count("*").alias("predicted"))
    j = per_true.join(per_pred, "class", "full").na.fill(0, ["support", "hit", "predicted"])
    prec = safe_div("hit", "predicted")
    rec = safe_div("hit", "support")
    return j.select("class", prec.alias("precision"), rec.alias("recall"),
                    safe_div(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"), "support")


def _score_table(df: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """Distinct scores with positives, negatives and those of lower scores: one grouping, one cumulative pass for both."""
    base = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_y"))
    pn = base.groupBy("_s").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    return running_sums(pn, "_s", ["pos", "neg"], buckets)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC with tied scores counted half (J26): the Mann-Whitney
    probability that a positive outranks a negative."""
    t = _score_table(df, label, score, buckets)
    a = t.agg(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("_u"),
              F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return a.select((F.col("_u") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """ROC curve at every distinct score taken as threshold (``score >=
    threshold`` predicts positive), plus the origin (J27)."""
    t = _score_table(df, label, score, buckets)
    tot = t.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pts = with_scalars(t, tot).select(F.col("_s").alias("threshold"), ((F.col("_N") - F.col("neg_below")) / F.col("_N")).alias("fpr"),
                                      ((F.col("_P") - F.col("pos_below")) / F.col("_P")).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.unionByName(origin)
