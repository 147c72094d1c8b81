import numpy as np
import pandas as pd
import pytest

import tessera.functions.quantiles as Q


def _frame(spark, seed=0, n=3000):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    hot = np.where(rng.random(n) < 0.34, 7.0, rng.exponential(size=n))   # a third of rows on one value
    ints = rng.integers(0, 5, size=n).astype(float)
    g = rng.choice(["x", "y", "z"], size=n, p=[0.6, 0.3, 0.1])
    a[::97] = np.nan
    pdf = pd.DataFrame({"a": a, "hot": hot, "ints": ints, "g": g})
    return spark.createDataFrame(pdf), pdf


def test_global_quantiles_exact(spark):
    df, pdf = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    vals, ex = Q.quantile_values(df, ["a", "hot", "ints"], probs)
    for c in ["a", "hot", "ints"]:
        for p in probs:
            assert vals[()][(c, p)] == pytest.approx(pdf[c].quantile(p), abs=1e-12)
        assert ex[()][f"__n_{['a', 'hot', 'ints'].index(c)}"] == pdf[c].count()


def test_kth_values(spark):
    df, pdf = _frame(spark, 2)
    vals, _ = Q.kth_values(df, "hot", lambda k, c, n: [0, n // 2, n - 1])
    s = np.sort(pdf["hot"].to_numpy())
    assert vals[()] == [s[0], s[len(s) // 2], s[-1]]


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    vals, _ = Q.quantile_values(df, ["x"], [0.25, 0.5])
    assert vals[()][("x", 0.5)] == 1.0
    empty = spark.createDataFrame([], "x double")
    vals, _ = Q.quantile_values(empty, ["x"], [0.5])
    assert vals[()][("x", 0.5)] is None
