import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import split as SP


def test_split_exact_and_disjoint(spark):
    df = spark.range(0, 1003).withColumn("g", (F.col("id") % 3).cast("string"))
    s = SP.train_test_split(df, 0.2, 42, key=["id"]).cache()
    assert s.count() == 1003
    assert s.where("split = 'test'").count() == math.ceil(0.2 * 1003)
    assert s.select("id").distinct().count() == 1003
    st = SP.train_test_split(df, 0.2, 42, key=["id"], stratify="g")
    counts = {r["g"]: r["count"] for r in st.where("split='test'").groupBy("g").count().collect()}
    assert sum(counts.values()) == math.ceil(0.2 * 1003)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_split_with_identical_rows(spark):
    # one row repeated on half the table: ties at the cut are resolved by expansion
    rows = [(1, "same")] * 500 + [(i, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v string")
    s = SP.train_test_split(df, 0.3, 1)
    assert s.count() == 1000 and s.where("split='test'").count() == 300


def test_split_without_shuffle(spark):
    df = spark.range(0, 100)
    s = SP.train_test_split(df, 0.1, shuffle=False, order_by="id")
    assert sorted(r["id"] for r in s.where("split='test'").collect()) == list(range(90, 100))


def test_stratify_guard(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    assert not SP.can_stratify(df, "t")


def test_class_report_and_confusion(spark):
    y = ["a", "a", "b", "b", "c"]
    p = ["a", "b", "b", "b", "a"]
    df = spark.createDataFrame(list(zip(y, p)), "label string, prediction string")
    rep = {r["class"]: r for r in M.class_report(df).collect()}
    assert rep["a"]["precision"] == 0.5 and rep["a"]["recall"] == 0.5
    assert rep["b"]["precision"] == pytest.approx(0.6667) and rep["b"]["recall"] == 1.0
    assert rep["c"]["precision"] == 0.0 and rep["c"]["f1_score"] == 0.0
    assert rep["accuracy"]["precision"] == 0.6
    cm = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion(df).collect()}
    assert len(cm) == 9 and cm[("c", "a")] == 1 and cm[("c", "c")] == 0
