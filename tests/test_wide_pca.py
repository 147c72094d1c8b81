import numpy as np
import pytest

from tessera.functions.linalg import fix_signs
from tessera.operators.wide_pca import fit_wide_pca


def arrays(spark, x, parts=4):
    return spark.createDataFrame([(i, None if r is None else [None if v is None or np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                                 "id long, v array<double>").repartition(parts)


def exact(x, scale=True):
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    sd = x.std(axis=0) if scale else np.ones(x.shape[1])
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
    vals, vecs = np.linalg.eigh(np.cov(z.T))
    return z, vals[::-1], vecs[:, ::-1]


@pytest.mark.parametrize("scale", [True, False])
def test_leading_components_equal_the_exact_ones(spark, scale):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 64)) @ rng.normal(size=(64, 64)) + 5
    x[rng.random(x.shape) < 0.02] = np.nan
    got = fit_wide_pca(arrays(spark, x), "v", 10, scale)
    z, vals, vecs = exact(x, scale)
    assert got.converged and got.passes <= 7
    assert np.allclose(got.explained_variance, vals[:10], rtol=1e-9) and np.allclose(got.ratio, vals[:10] / vals.sum(), rtol=1e-9)
    assert np.allclose(got.components, fix_signs(vecs[:, :10]), atol=1e-6)
    scores = got.transform(arrays(spark, x), ["id"], 3).orderBy("id").toPandas()
    assert list(scores.columns) == ["id", "PC1", "PC2", "PC3"]
    assert np.allclose(scores[["PC1", "PC2", "PC3"]], z @ got.components[:, :3], atol=1e-8)


def test_columns_as_arrays(spark):
    x = np.random.default_rng(1).normal(size=(90, 4)) * [1, 2, 3, 0] + 7
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double")
    got = fit_wide_pca(df, ["a", "b", "c", "d"], 3, False)
    _, vals, vecs = exact(x, False)
    assert np.allclose(got.explained_variance, vals[:3]) and np.allclose(got.components, fix_signs(vecs[:, :3]), atol=1e-6)
    assert got.transform(df).columns == ["PC1", "PC2", "PC3"]


def test_five_thousand_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 12)) * np.arange(12, 0, -1) @ rng.normal(size=(12, 5000)) + rng.normal(size=(120, 5000))
    got = fit_wide_pca(arrays(spark, x), "v", 10, False)
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert got.converged and np.allclose(got.explained_variance, s[:10] ** 2 / 119, rtol=1e-9)
    assert np.allclose(got.components, fix_signs(vt[:10].T), atol=1e-6)


def test_few_equal_and_missing_rows(spark):
    same = fit_wide_pca(arrays(spark, [[1.0, 2.0, 3.0]] * 5), "v", 2)
    assert same.explained_variance.tolist() == [0.0, 0.0]
    gone = fit_wide_pca(arrays(spark, [[1.0, 2.0], None, [2.0, 5.0], [4.0, 4.0]]), "v", 1, False)
    _, vals, _ = exact(np.array([[1.0, 2.0], [np.nan, np.nan], [2.0, 5.0], [4.0, 4.0]]), False)
    assert gone.n == 4 and gone.explained_variance[0] == pytest.approx(vals[0])
    with pytest.raises(ValueError, match="no "):
        fit_wide_pca(arrays(spark, [[1.0]]).limit(0), "v")
    with pytest.raises(Exception, match="other lengths"):
        fit_wide_pca(arrays(spark, [[1.0], [1.0, 2.0]]), "v")
