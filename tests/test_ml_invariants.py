"""Model-side invariants."""

import random

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lapse.operators import metrics as mt
from lapse.operators import ml
from conftest import SF_SMALL


def _frame(spark, n=600, seed=17):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1 if rnd.random() < 0.35 else 0
        rows.append((f"c{i}", rnd.choice(["a", "b", "c"]), rnd.choice(["s1", "s2"]), "delivered", rnd.choice(["card", "boleto"]),
                     rnd.randint(1, 10), rnd.uniform(10, 500) + 80 * y, rnd.randint(1, 5), rnd.uniform(5, 300),
                     rnd.uniform(100, 3000), rnd.uniform(0, 90000), rnd.choice(["x", "y"]), rnd.choice(["s1", "s3"]),
                     rnd.choice(["toys", "tools"]), rnd.randint(3, 15), y))
    return spark.createDataFrame(rows, "customer_unique_id string, customer_city string, customer_state string, order_status string, "
                                       "payment_type string, payment_installments long, payment_value double, review_score long, "
                                       "price double, product_weight_g double, approval_delay double, seller_city string, "
                                       "seller_state string, product_category_name string, RFM_Score int, is_churned int")


def test_split_shares_per_class(spark):
    df = _frame(spark)
    s = ml.stratified_split(df).groupBy("is_churned", "is_test").count().collect()
    by = {(r.is_churned, r.is_test): r["count"] for r in s}
    for y in (0, 1):
        n = by[(y, True)] + by[(y, False)]
        assert by[(y, True)] == round(0.3 * n)


def test_tree_model_scores_and_importances(spark):
    df = _frame(spark)
    model = ml.fit(df, "tree", ml.NUMERIC_FEATURES_APP)
    scored = ml.score(model, df)
    r = scored.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0
    imp = ml.feature_importance(model, 1000).collect()
    assert abs(sum(x.importance for x in imp) - 1.0) < 1e-9
    assert {x.feature.split("_")[0] for x in imp} <= {n.split("_")[0] for n in ml.NUMERIC_FEATURES_APP + ml.CATEGORICAL_FEATURES}


def test_auc_equals_exact_evaluator(spark):
    df = _frame(spark)
    model = ml.fit(df, "logistic", ml.NUMERIC_FEATURES_APP)
    scored = ml.score(model, df).withColumn("label", F.col("is_churned").cast("double"))
    ours = mt.roc_auc(scored, "label", "score").first().roc_auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert abs(ours - ev.evaluate(scored)) < 1e-9


def test_each_customer_in_one_cluster(spark):
    import __spark_entry__ as E
    c = E.queries()["cluster_customers"](spark, SF_SMALL)
    n = c.count()
    assert c.select("customer_unique_id").distinct().count() == n
    assert c.where(F.col("Cluster").isNull()).count() == 0
    assert sorted(r.Cluster for r in c.select("Cluster").distinct().collect()) == [0, 1, 2, 3]
    means = [r["m"] for r in c.groupBy("Cluster").agg(F.avg("MonetaryValue").alias("m")).orderBy("Cluster").collect()]
    assert means == sorted(means, reverse=True)   # ids ranked by mean monetary value
