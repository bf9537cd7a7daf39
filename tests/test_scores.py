"""Scores of node tables: values and ends are looked up by batch, however many splits there are."""

import random

import numpy as np
import pytest

from lapse.operators.trees import NODE_SCHEMA, Params, score


def test_many_values_are_no_expressions_of_the_plan(spark):
    rnd = random.Random(4)
    nodes, want = [], {}
    for t in range(300):  # one split a tree: by a value, or by an end
        by_value, end = t % 2 == 0, rnd.uniform(0, 50)
        nodes.append((t, 1, 0, 2 if by_value else 1, "c" if by_value else "a", t if by_value else None, None if by_value else end, 1.0, 0.0, 1.0, 9, 0.5, f"value {t}" if by_value else None))
        nodes += [(t, 2 + side, 1, 0, None, None, None, 0.0, 0.0, 1.0, 5, float(side), None) for side in (0, 1)]
    table = spark.createDataFrame(nodes, f"{NODE_SCHEMA}, feature_value string")
    rows = [(i, None if i == 7 else float("nan") if i == 8 else rnd.uniform(0, 50), rnd.choice([None, f"value {i}", "other"])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, c string")
    scored = score(df, table, Params(trees=300, depth=1))
    assert len(scored._jdf.queryExecution().optimizedPlan().toString()) < 5000
    got = {r["id"]: r["score"] for r in scored.collect()}
    for i, a, c in rows:
        right = [c is not None and n[12] == c if n[3] == 2 else a is not None and (np.isnan(a) or a > n[6]) for n in nodes if n[1] == 1]
        assert got[i] == pytest.approx(sum(right) / 300)


def test_rows_are_scored_once_for_all_metrics(spark):
    """Counts and ROC-AUC read stored scores; before, each of their passes walked all trees again."""
    from pyspark.sql import functions as F

    from lapse.operators import ml
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    df = spark.createDataFrame([(i % 2, ((i * 7) % 11) / 10) for i in range(100)], "is_churned int, x double").repartition(2)
    row = ml.evaluate(df.withColumn("score", counted.asNondeterministic()("x")).withColumn("prediction", (F.col("score") > 0.5).cast("int"))).first()
    assert row["tp"] + row["fp"] == sum(((i * 7) % 11) / 10 > 0.5 for i in range(100)) and calls.value == 100
