import numpy as np
import pandas as pd
import pytest

from tessera.functions import linalg as L
from tessera.operators import stats as S


@pytest.mark.parametrize("width", [1024, 17])
def test_wide_correlation_with_missing_values(spark, monkeypatch, width):
    """Against pandas' pairwise complete correlations; one block of columns and several."""
    monkeypatch.setattr(L, "MASKED_WIDTH", width)
    rng = np.random.default_rng(3)
    d = 60 if width < 60 else 120
    x = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) * rng.uniform(0.01, 1e4, d) + rng.normal(size=d) * 1e5
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 7.0                       # constant
    x[:, 6] = np.nan                    # nothing there
    x[:, 7] = np.where(np.arange(300) < 299, np.nan, 1.0)
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(d)])
    got = S.corr_matrix(spark.createDataFrame(pdf).repartition(4)).toPandas()
    r = got.pivot(index="i", columns="j", values="r").to_numpy(dtype=float)
    want = pdf.corr(min_periods=2).to_numpy()
    want[5], want[:, 5] = np.nan, np.nan
    np.testing.assert_allclose(r, want, atol=1e-9)
    assert got.a.iloc[1] == "c0" and got.b.iloc[1] == "c1"


def test_wide_and_narrow_agree(spark, lineitem):
    narrow = S.corr_matrix(lineitem, digits=6).collect()
    wide = S.corr_matrix(lineitem, digits=6, chunk=0).collect()
    assert [(r.a, r.b, r.r) for r in sorted(narrow)] == [(r.a, r.b, pytest.approx(r.r, abs=1.1e-6)) for r in sorted(wide)]
    assert S.corr_matrix(lineitem.limit(0), chunk=0).where("r is not null").count() == 0


def test_five_hundred_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 500))
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(500)]))
    r = S.corr_matrix(df).toPandas().r.to_numpy(dtype=float).reshape(500, 500)
    np.testing.assert_allclose(r, pd.DataFrame(x).corr(min_periods=2).to_numpy(), atol=1e-9)
