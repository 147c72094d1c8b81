"""Answers that were wrong once, and caps that are gone."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import charts as C
from tessera.operators import cluster as K
from tessera.operators import discriminant as D
from tessera.operators import factor as FA
from tessera.operators import insights as I
from tessera.operators import normality as N
from tessera.operators import preprocess as R
from tessera.operators import quality as Q
from tessera.operators import stats as S
from tessera.operators.split import train_test_split
from tessera.sources.readers import read_table


@pytest.mark.parametrize("kind", ["bigint", "double", "date", "timestamp_ntz", "string"])
def test_unshuffled_split_keeps_all_rows(spark, kind):
    value = {"bigint": "id + 9007199254740993", "double": "id * 0.5", "date": "date_add(date'2020-01-01', cast(id as int))",
             "timestamp_ntz": "cast(timestamp'2020-01-01' + make_interval(0,0,0,0,cast(id as int)) as timestamp_ntz)",
             "string": "lpad(cast(id as string), 12, '0')"}[kind]
    df = spark.range(100).selectExpr("id", f"cast(CASE WHEN id % 10 = 3 THEN NULL ELSE {value} END as {kind}) AS o")
    got = train_test_split(df, 0.2, key=["id"], shuffle=False, order_by="o").collect()
    assert len(got) == 100 and sum(r.split == "test" for r in got) == 20
    known = sorted((r.id for r in got if r.o is not None), reverse=True)
    assert {r.id for r in got if r.split == "test"} == set(known[:20])


def test_ties_give_the_largest_keys(spark):
    df = spark.range(90).selectExpr("id", "id % 3 AS o")
    got = train_test_split(df, 0.5, key=["id"], shuffle=False, order_by="o").collect()
    order = sorted(((r.o, r.id) for r in got), reverse=True)
    assert {(r.o, r.id) for r in got if r.split == "test"} == set(order[:45])


def test_a_third_of_the_rows_equal(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS a", "'x' AS b")
    for shuffle, by in ((True, None), (False, "b")):
        got = train_test_split(df, 0.3, shuffle=shuffle, order_by=by)
        assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"test": 900, "train": 2100}
        assert sorted(r.a for r in got.collect()) == sorted(r.a for r in df.collect())


def test_select_k_best_ranks_unrounded(spark):
    rows = [(i % 2, (i % 2) * 0.001 + (i * 37 % 101), (i % 2) * 0.002 + (i * 37 % 101), float(i % 2)) for i in range(202)]
    df = spark.createDataFrame(rows, "y int, a double, b double, p double")
    score = {r.feature: r.score for r in R.f_classif(df, ["a", "b", "p"], "y", None).collect()}
    assert score["b"] > score["a"] and math.isinf(score["p"])
    assert [r.feature for r in R.select_k_best(df, ["b", "a"], "y", 1)[1].collect()] == ["b"]
    assert [r.feature for r in R.select_k_best(df, ["a", "p", "b"], "y", 1)[1].collect()] == ["p"]
    line = spark.range(50).selectExpr("cast(id as double) AS y", "id * 2.0 AS exact", "cast(id % 7 as double) AS poor")
    assert math.isinf({r.feature: r.score for r in R.f_regression(line, ["exact", "poor"], "y").collect()}["exact"])


def test_csv_with_quotes(spark, tmp_path):
    want = pd.DataFrame({"a": ['x "y" z', "line\nbreak", "plain, comma"], "n": [1, 2, 3]})
    path = tmp_path / "q.csv"
    want.to_csv(path, index=False)
    got = read_table(spark, str(path), multi_line=True).toPandas()
    assert got.a.tolist() == want.a.tolist() and got.n.tolist() == [1, 2, 3]
    want.drop(1).to_csv(path, index=False)
    assert read_table(spark, str(path)).toPandas().a.tolist() == ['x "y" z', "plain, comma"]


def test_grouped_stats_nan_key_and_hot_group(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (None, 4.0), (1.0, 5.0)], "k double, v double")
    assert [(r.k, r.v_mean, r.v_median) for r in S.grouped_stats(df, "k", ["v"]).collect()] == [(1.0, 3.5, 3.5)]
    monkeypatch.setattr(S, "BAND_LIMIT", 50)
    many = spark.range(400).selectExpr("CASE WHEN id < 200 THEN 0 ELSE id END AS k", "cast(id * 7 % 31 as double) AS v")
    got = {r.k: (r.v_mean, r.v_std, r.v_median) for r in S.grouped_stats(many, "k", ["v"]).collect()}
    p = many.toPandas().groupby("k").v.agg(["mean", "std", "median"]).round(3)
    assert len(got) == 201 and got[0] == pytest.approx(tuple(p.loc[0]), abs=1e-3)


def test_levels_use_unrounded_ratios(spark):
    df = spark.range(700002).selectExpr("CASE WHEN id < 500002 THEN 'a' WHEN id < 600002 THEN 'b' ELSE 'c' END AS t")
    row = S.class_imbalance(df, "t").first()
    assert row.ratio == 5.0 and row.level == "severe"  # 5.00002


def test_lda_needs_more_rows_than_classes(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0), (1.0, 0.0, 1.0)], "__z0 double, __z1 double, label double")
    with pytest.raises(ValueError, match="more rows than classes"):
        D.fit_lda(df, 2, ["a", "b"])


def test_factor_count_is_checked(spark, lineitem):
    with pytest.raises(ValueError, match="factors"):
        FA.fit_fa(lineitem, ["l_quantity", "l_tax", "l_discount"], 3)


def test_kmeans_scan_and_metrics(spark):
    df = spark.range(600).selectExpr("cast(id % 3 * 10 + rand(1) as double) AS a", "cast(id % 3 * -7 + rand(2) as double) AS b")
    rows = K.kmeans_scan(df, ks=[2, 3, 4]).collect()
    assert [r.k for r in rows if r.best] == [3] and rows[0].inertia > rows[1].inertia > rows[2].inertia
    assert rows[1].silhouette > 0.95 and 0 < rows[1].davies_bouldin < 0.3


def test_normality_over_all_rows(spark):
    df = spark.range(20000).selectExpr("randn(3) AS g", "exp(randn(4)) AS e", "1.0D AS c")
    got = {r.column: r for r in N.normality(df).collect()}
    assert got["g"].n == 20000 and got["g"].normal and not got["e"].normal and got["c"].jb is None and not got["c"].normal


def test_violin_parts(spark):
    df = spark.range(100).selectExpr("CASE WHEN id = 0 THEN 1000.0D ELSE cast(id % 10 as double) END AS v", "'g' AS g")
    assert [(r.g, r.value, r.n) for r in C.violin_outliers(df, "v", "g").collect()] == [("g", 1000.0, 1)]
    assert [(r.value, r.n) for r in C.violin_outliers(df, "v").collect()] == [(1000.0, 1)]
    assert C.box_stats(df, "v", "g").first().n_outliers == 1
    assert C.violin_stats(df, "v", "g").agg(F.sum("share")).first()[0] == pytest.approx(1, abs=1e-4)


def test_scatter_bins_count_every_row(spark, lineitem):
    assert C.scatter_bins(lineitem, "l_quantity", "l_tax", bins=7).agg(F.sum("n")).first()[0] == lineitem.count()
    flat = spark.range(5).selectExpr("1.0D AS x", "cast(id as double) AS y")
    assert C.scatter_bins(flat, "x", "y").agg(F.sum("n")).first()[0] == 5


def test_duplicate_rows_hot(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS a")
    assert [r.a for r in Q.duplicate_rows(df, 5).collect()] == [-1] * 5
    assert Q.duplicate_rows(df, None).count() == 1000


def test_crosstab_counted_cells(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "x string, y int")
    assert sorted((r.x, r.y, r["count"]) for r in S.crosstab(df, "x", "y").collect()) == [("a", 1, 2), ("a", 2, 0), ("b", 1, 0), ("b", 2, 1)]
    assert S.crosstab(df, "x", "y", zeros=False).count() == 2


def test_findings(spark):
    rows = [(20.0 + i % 7, 50.0 + i, 0.0 if i % 4 else 9.0, 1000.0 + 2 * i, None if i % 3 else 1.0, f"d{i}", "big" if i % 9 else "small") for i in range(90)]
    df = spark.createDataFrame(rows, "temp double, humidity double, rain double, pressure double, gap double, date string, kind string")
    report = I.insights(df, "kind")
    codes = {r.code: r for r in report.collect()}
    assert {"size", "missing", "missing_high", "missing_drop", "duplicates_none", "target", "imbalance_severe", "temperature", "humidity",
            "rainfall", "dry", "pressure", "season", "high_corr", "high_corr_pair", "merge_corr", "outliers_ok", "skewed", "transform",
            "models", "analyses"} <= codes.keys()
    temp = [20.0 + i % 7 for i in range(90)]
    assert codes["temperature"].value == pytest.approx(sum(temp) / 90, abs=1e-4)
    assert f"standard deviation {pd.Series(temp).std():.1f}, from 20.0 to 26.0" in codes["temperature"].message
    assert codes["imbalance_severe"].value == 8.0 and codes["dry"].value == pytest.approx(100 * 67 / 90)
    assert codes["high_corr_pair"].value == pytest.approx(1) and "dimensionality" not in codes and "missing_median" not in codes
    lines = [r.value for r in I.insights_text(report).collect()]
    assert lines[0] == "## Findings" and "### Warnings" in lines and len(lines) == report.count() + 2 + 8
    spread = I.insights(spark.range(100).selectExpr("CASE WHEN id % 10 = 0 THEN 1000.0D ELSE cast(id as double) END AS v"))
    assert {"outliers", "robust"} <= {r.code for r in spread.collect()}
    clean = I.insights(spark.range(10).selectExpr("id AS a", "id % 4 AS b"))
    assert {"missing_none", "duplicates_none", "outliers_ok"} <= {r.code for r in clean.collect()}
    assert I.insights(spark.createDataFrame([], "a double, b string")).count() > 0


def test_kernel_machine_and_forest(spark):
    """Rings: no line separates them."""
    from tessera.operators import models as MO
    df = spark.range(240).selectExpr(
        "id", "(1 + id % 2 * 2) * cos(id * 0.7) AS a", "(1 + id % 2 * 2) * sin(id * 0.7) AS b", "if(id % 2 = 0, 'in', 'out') AS t")
    table, best, pred = MO.compare_models(df, "t", ["a", "b"], ["logistic", "svm", "random_forest"], key=["id"])
    acc = {r.model: r.test_accuracy for r in table.collect()}
    assert acc["SVM"] > 0.95 and acc["Random Forest"] > 0.9 and acc["Logistic Regression"] < 0.8
    assert best in ("svm", "random_forest") and pred.count() == 48 and set(pred.columns) == {"actual", "predicted"}


def test_components_for_a_share_and_scores(spark, lineitem):
    from tessera.operators import reduce as RD
    m = RD.fit_pca(lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 4)
    n = m.n_components_for(0.95)
    assert sum(m.ratio[:n]) >= 0.95 > sum(m.ratio[:n - 1])
    assert RD.fit_pca(lineitem, ["l_quantity", "l_discount", "l_tax"], 1).n_components_for(0.95) is None


def test_feature_finder(spark):
    from tessera.functions.columns import find_features
    df = spark.range(1).selectExpr("1 AS air_temp", "2.0 AS wind", "'x' AS temp_note", "3 AS other")
    assert find_features(df, ["temp", "wind"]) == ["air_temp", "wind"]
    assert find_features(df, ["none"]) == ["air_temp", "wind", "other"]


def test_named_results_round_trip(spark, tmp_path):
    from tessera.sources import writers as W
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"q')], "i long, s string")
    W.write_csv(df, str(tmp_path / "x.csv"))
    assert sorted(read_table(spark, str(tmp_path / "x.csv")).collect()) == sorted(df.collect())
    where = W.write_result(df, str(tmp_path), "train", "csv")
    assert sorted(read_table(spark, where, fmt="csv").collect()) == sorted(df.collect())
    assert spark.read.parquet(W.write_result(df, str(tmp_path), "stats")).count() == 2
