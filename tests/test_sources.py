"""Sources: CSV read with schema and index column, checks, model persistence."""

import os
import tempfile

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer

from lapse.sources.tables import (describe_schema, drop_index_column, load_model, read_table,
                                  require_columns, save_model)


def _csv(text):
    d = tempfile.mkdtemp(prefix="lapse-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_read_csv_with_schema_drops_index_and_keeps_zip_text(spark):
    p = _csv(",seller_id,seller_zip_code_prefix,seller_city,seller_state\n0,s1,01234,sao paulo,SP\n1,s2,99999,rio,RJ\n")
    df = read_table(spark, p, "sellers")
    assert df.columns == ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]
    assert [r.seller_zip_code_prefix for r in df.orderBy("seller_id").collect()] == ["01234", "99999"]


def test_read_csv_inferred_blank_header(spark):
    p = _csv(",a,b\n0,1,x\n1,2,y\n")
    df = read_table(spark, p)
    assert df.columns == ["a", "b"]
    assert drop_index_column(df).columns == ["a", "b"]


def test_require_columns_and_schema(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert require_columns(df, ["k"]) is df
    with pytest.raises(KeyError):
        require_columns(df, ["k", "missing"])
    rows = describe_schema(df).collect()
    assert [(r.column, r.type) for r in rows] == [("k", "int"), ("v", "string")]


def test_save_and_load_pipeline(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    model = Pipeline(stages=[StringIndexer(inputCol="c", outputCol="i")]).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="lapse-model-"), "m")
    save_model(model, path)
    again = load_model(path)
    assert [r.i for r in again.transform(df).collect()] == [r.i for r in model.transform(df).collect()]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    from lapse.sources.tables import read_table
    cases = {"index.csv": ",order_id,payment_sequential,payment_type,payment_installments,payment_value\n0,00a,1,card,2,10.5\n",
             "plain.csv": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n00a,1,card,2,10.5\n",
             "moved.csv": "payment_value,payment_type,order_id,extra,payment_installments,payment_sequential\n10.5,card,00a,x,2,1\n"}
    for name, body in cases.items():
        (tmp_path / name).write_text(body)
        r = read_table(spark, str(tmp_path / name), "order_payments")
        assert r.columns == ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"]
        assert tuple(r.first()) == ("00a", 1, "card", 2, 10.5)
    (tmp_path / "short.csv").write_text("order_id,payment_value\n00a,oops\n")
    assert tuple(read_table(spark, str(tmp_path / "short.csv"), "order_payments").first()) == ("00a", None, None, None, None)


def test_a_cluster_must_name_its_shared_folder(spark):
    import pytest
    from lapse.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())
