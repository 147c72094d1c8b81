import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import profile as P
from tessera.operators import quality as Q
from tessera.operators import stats as S


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1.0, None, 5.0, "a", True), (2.0, None, 5.0, "b", False), (float("nan"), None, 5.0, None, True),
            (4.0, None, 5.0, "a", True), (4.0, None, 5.0, "a", True), (None, None, 5.0, "b", None)]
    return spark.createDataFrame(rows, "x double, allnull double, const double, s string, flag boolean")


def test_profile_nan_and_null(edge):
    p = {r["column"]: r for r in P.profile(edge).collect()}
    assert p["x"]["nulls"] == 2 and p["x"]["n_distinct"] == 3
    assert p["allnull"]["nulls"] == 6 and p["allnull"]["n_distinct"] == 0
    assert p["flag"]["dtype"] == "boolean"
    assert P.numeric_cols(edge) == ["x", "allnull", "const"]
    assert "flag" in P.categorical_cols(edge)


def test_quality_summary_and_duplicates(edge):
    r = Q.quality_summary(edge).collect()[0]
    assert r["rows"] == 6 and r["duplicate_rows"] == 1 and r["complete_rows"] == 0
    assert r["total_missing"] == 2 + 6 + 1 + 1
    assert Q.duplicate_rows(edge).count() == 2
    assert Q.drop_duplicates(edge).count() == 5


def test_empty_frame(spark):
    e = spark.createDataFrame([], "x double, s string")
    r = Q.quality_summary(e).collect()[0]
    assert r["rows"] == 0 and r["missing_pct"] is None
    assert P.profile(e).count() == 2


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.exponential(size=500), "b": rng.integers(0, 9, 500).astype(float)})
    d = {r["column"]: r for r in S.describe(spark.createDataFrame(pdf), digits=None).collect()}
    for c in ["a", "b"]:
        s = pdf[c]
        assert d[c]["mean"] == pytest.approx(s.mean())
        assert d[c]["std"] == pytest.approx(s.std())
        assert d[c]["median"] == pytest.approx(s.median())
        assert d[c]["q1"] == pytest.approx(s.quantile(0.25))
        assert d[c]["skewness"] == pytest.approx(s.skew())
        assert d[c]["kurtosis"] == pytest.approx(s.kurtosis())
        assert d[c]["mode"] == pytest.approx(s.mode().iloc[0])


def test_constant_and_small_moments(edge, spark):
    d = {r["column"]: r for r in S.describe(edge, ["const", "x"], digits=None).collect()}
    assert d["const"]["skewness"] == 0.0 and d["const"]["kurtosis"] == 0.0
    two = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    r = S.describe(two).collect()[0]
    assert r["skewness"] is None and r["kurtosis"] is None


def test_iqr_matches_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"v": np.concatenate([rng.normal(size=400), [15.0, -12.0, 30.0]])})
    r = Q.iqr_outliers(spark.createDataFrame(pdf)).collect()[0]
    q1, q3 = pdf.v.quantile(0.25), pdf.v.quantile(0.75)
    n_out = int(((pdf.v < q1 - 1.5 * (q3 - q1)) | (pdf.v > q3 + 1.5 * (q3 - q1))).sum())
    assert r["outliers"] == n_out and r["q1"] == pytest.approx(round(q1, 3))


def test_corr_matrix_pairwise_and_constant(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, None, 5.0], "b": [2.0, 4.1, 6.0, 8.0, None], "c": [1.0] * 5})
    m = {(r["a"], r["b"]): r["r"] for r in S.corr_matrix(spark.createDataFrame(pdf)).collect()}
    assert m[("a", "b")] == pytest.approx(pdf.corr().loc["a", "b"])
    assert m[("a", "c")] is None and m[("c", "c")] is None and m[("a", "a")] == 1.0


def test_target_detection(spark):
    df = spark.createDataFrame([(1.0, "Sunny", 3), (2.0, "Rainy", 3), (3.0, "Sunny", 4)],
                               "Temperature double, WeatherType string, code int")
    assert P.detect_target(df) == "WeatherType"
    df2 = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, tag string")
    assert P.detect_target(df2) == "tag"
    df3 = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert P.detect_target(df3) is None


def test_crosstab_keeps_zero_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    got = {(r["p"], r["q"]): r["count"] for r in S.crosstab(df, "p", "q").collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 0}


def test_grouped_stats(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["u", "v"], 300), "x": rng.normal(size=300)})
    got = {r["k"]: r for r in S.grouped_stats(spark.createDataFrame(pdf), "k", ["x"]).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k]["x_median"] == pytest.approx(round(g.x.median(), 3), abs=1e-9)
        assert got[k]["x_std"] == pytest.approx(round(g.x.std(), 3), abs=1e-9)


def test_corr_matrix_inexact_constants(spark):
    pdf = pd.DataFrame({"a": [0.1] * 7 + [0.3], "b": [0.7, 0.1, 0.2, 0.9, 0.3, 0.3, 0.5, None],
                        "c": [1.5, 2.5, 0.5, 3.5, 1.0, 2.0, 0.7, 1.1]})
    m = {(r["a"], r["b"]): r["r"] for r in S.corr_matrix(spark.createDataFrame(pdf)).collect()}
    assert m[("a", "b")] is None                     # a is constant on the rows where b is present
    assert m[("b", "c")] == pytest.approx(pdf.corr().loc["b", "c"])
    assert m[("a", "c")] == pytest.approx(pdf.corr().loc["a", "c"])
