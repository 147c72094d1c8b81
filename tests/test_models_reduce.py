import numpy as np
import pandas as pd
import pytest

from tessera.operators import cluster as K
from tessera.operators import discriminant as D
from tessera.operators import factor as FA
from tessera.operators import models as MO
from tessera.operators import normality as N
from tessera.operators import reduce as RD

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


def test_pca_matches_numpy(lineitem):
    m = RD.fit_pca(lineitem, FEATS, 5)
    x = lineitem.select(*FEATS).toPandas().to_numpy(float)
    z = (x - x.mean(0)) / x.std(0)
    cov = np.cov(z.T)
    vals, vecs = np.linalg.eigh(cov)
    assert np.allclose(m.explained_variance, vals[::-1], atol=1e-8)
    # orthonormal loadings reproduce the covariance at full rank
    assert np.allclose(m.components.T @ m.components, np.eye(5), atol=1e-8)
    assert np.allclose(m.components @ np.diag(m.explained_variance) @ m.components.T, cov, atol=1e-8)
    scores = m.transform(lineitem, [], 5).toPandas().to_numpy()
    assert np.allclose(scores, z @ m.components, atol=1e-6)


def test_lda_matches_numpy(lineitem):
    r = D.lda_analysis(lineitem, "l_returnflag", FEATS)
    s = r["split"].where("split='train'").toPandas()
    x = s[[f"__z{i}" for i in range(5)]].to_numpy()
    y = s["label"].to_numpy().astype(int)
    k = 3
    means = np.array([x[y == c].mean(0) for c in range(k)])
    pri = np.bincount(y) / len(y)
    xc = np.concatenate([x[y == c] - means[c] for c in range(k)])
    std = xc.std(0)
    _, sv, vt = np.linalg.svd(np.sqrt(1 / (len(x) - k)) * xc / std, full_matrices=False)
    sc = (vt / std).T / sv
    xbar = pri @ means
    xb = (np.sqrt(len(x) * pri / (k - 1)) * (means - xbar).T).T @ sc
    _, s2, _ = np.linalg.svd(xb, full_matrices=False)
    assert np.allclose(r["model"].ratio, (s2 ** 2 / np.sum(s2 ** 2))[:2], atol=1e-9)
    assert r["report"].count() == 3 + 3


def test_factor_analysis_invariants(lineitem):
    m = FA.fit_fa(lineitem, FEATS, 2, None)
    comm = np.sum(m.loadings ** 2, axis=1)
    # holds at convergence; the fit stops on a 1e-2 log-likelihood tolerance
    assert np.allclose(comm + m.psi, 1.0, atol=5e-3)
    rot = FA.fit_fa(lineitem, FEATS, 2, "varimax")
    assert np.allclose(np.sum(rot.loadings ** 2, axis=1), comm, atol=1e-6)


def test_kmeans_cost_falls_with_k(lineitem):
    costs = [K.fit_kmeans(lineitem, FEATS, k, n_init=1, max_iter=20).cost for k in (2, 4)]
    assert costs[1] < costs[0]


def test_normality_equals_numpy(lineitem):
    """The moment test that took the place of the sampled Shapiro-Wilk."""
    got = {r["column"]: r for r in N.normality(lineitem, ["l_quantity", "l_extendedprice"]).collect()}
    x = lineitem.select("l_quantity", "l_extendedprice").toPandas()
    for c in x:
        z = (x[c] - x[c].mean()) / x[c].std(ddof=0)
        jb = len(z) / 6 * ((z ** 3).mean() ** 2 + ((z ** 4).mean() - 3) ** 2 / 4)
        assert got[c]["n"] == len(z) and got[c]["jb"] == pytest.approx(jb, abs=1e-3)
        assert got[c]["p_value"] == pytest.approx(np.exp(-jb / 2), abs=1e-6) and got[c]["normal"] == (np.exp(-jb / 2) > 0.05)


def test_compare_models_logistic(lineitem):
    tab, best, pred = MO.compare_models(lineitem, "l_returnflag", FEATS, ["logistic"])
    r = tab.collect()[0]
    # return flags are drawn without regard to the features: near the share of the largest class
    assert 0.2 < r["test_accuracy"] < 0.5 and best == "logistic"
    assert pred.count() == 1200


def test_many_rows_in_one_partition_are_dealt_out(spark, monkeypatch):
    from tessera.operators import models as MO
    df = spark.range(0, 400, 1, 1).selectExpr("id", "cast(id % 10 AS double) AS a", "cast(id % 7 AS double) AS b", "if(id % 3 > 0, 'x', 'y') AS t")
    cores = spark.sparkContext.defaultParallelism
    few, _ = MO.split_frame(df, ["a", "b"], "t", key=["id"])
    monkeypatch.setattr(MO, "SPREAD_ROWS", 400)
    many, _ = MO.split_frame(df, ["a", "b"], "t", key=["id"])
    assert many.rdd.getNumPartitions() >= cores
    assert few.orderBy("id").collect() == many.orderBy("id").collect()
    few.unpersist()
    many.unpersist()
