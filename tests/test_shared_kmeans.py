import numpy as np
import pytest

from tessera.functions import linalg as L
from tessera.operators import cluster as K
from tessera.operators import shared_kmeans as SK


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.4, size=(150, 3)) for m in ([0, 0, 0], [4, 0, 1], [0, 5, -2], [4, 4, 4])])
    x[::50] = x[0]  # repeated rows
    return x, spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(5).persist()


def plain(x, c, steps):
    for _ in range(steps):
        lab = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[lab == j].mean(axis=0) if (lab == j).any() else c[j] for j in range(len(c))])
    dist = ((x[:, None] - c) ** 2).sum(axis=2)
    return c, dist.min(axis=1).sum(), np.bincount(dist.argmin(axis=1), minlength=len(c))


@pytest.mark.parametrize("direct", [4_000_000, 0])
def test_iterations_against_numpy(points, direct, monkeypatch):
    monkeypatch.setattr(L, "DIRECT", direct)
    x, df = points
    starts = [x[[0, 200, 400]], x[[1, 2]], np.array([[100.0, 100.0, 100.0], [0.0, 0.0, 0.0]])]  # the last has an empty cluster
    for fit, start in zip(SK.lloyd(df, 3, starts, 3, 0.0), starts):
        c, cost, sizes = plain(x, start, fit.iterations)
        np.testing.assert_allclose(fit.centers, c, atol=1e-9)
        assert fit.cost == pytest.approx(cost, rel=1e-9) and fit.sizes.tolist() == sizes.tolist()


def test_shared_fits_are_the_single_fits(points):
    x, df = points
    ks, seeds = [2, 4, 4, 7], [1, 1, 2, 3]
    together = SK.fit_all(df, 3, ks, seeds, 100, 1e-6)
    for fit, k, s in zip(together, ks, seeds):
        (alone,) = SK.fit_all(df, 3, [k], [s], 100, 1e-6)
        assert fit.cost == pytest.approx(alone.cost, rel=1e-6) and fit.sizes.tolist() == alone.sizes.tolist()
    assert min(f.cost for f in together if f.k == 4) == pytest.approx(plain(x, x[[0, 200, 400, 599]], 50)[1], rel=1e-3)


def test_measures_against_pairs(points):
    x, df = points
    res = K.fit_kmeans(df, ["a", "b", "c"], 4, n_init=2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    lab = ((z[:, None] - res.centers) ** 2).sum(axis=2).argmin(axis=1)
    pair = ((z[:, None] - z) ** 2).sum(axis=2)
    sil = []
    for i in range(len(z)):
        mean = [pair[i, lab == j].sum() / max((lab == j).sum() - (lab[i] == j), 1) for j in range(4)]
        own, other = mean[lab[i]], min(m for j, m in enumerate(mean) if j != lab[i])
        sil.append((other - own) / max(own, other))
    c = np.array([z[lab == j].mean(axis=0) for j in range(4)])
    s = np.array([np.linalg.norm(z[lab == j] - c[j], axis=1).mean() for j in range(4)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(4) if j != i) for i in range(4)])
    got = K.cluster_metrics(res.assign(df), res, None).first()
    assert (got.silhouette, got.davies_bouldin) == (pytest.approx(np.mean(sil)), pytest.approx(db))
    assert got.inertia == pytest.approx(sum(((z[lab == j] - c[j]) ** 2).sum() for j in range(4)))
    (near,) = SK.measures(df.selectExpr(*[f"(({n}) - {m}) / {d} AS {n}" for n, m, d in zip("abc", x.mean(axis=0), x.std(axis=0))]), 3, [res.centers])
    assert near == pytest.approx((got.inertia, got.silhouette, got.davies_bouldin))


def test_small_inputs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 4.0)], "a double, b double")
    res = K.fit_kmeans(df, ["a", "b"], 4, n_init=2)  # fewer distinct rows than clusters
    assert res.k == 2 and res.cost == pytest.approx(0) and sorted(res.sizes) == [1, 2]
    assert [r.cluster for r in res.assign(df).orderBy("a").collect()] == [0, 0, 1]
    assert K.kmeans_scan(df.limit(0), ["a", "b"]).count() == 0


def test_fits_of_many_rows_start_near_where_they_settle(spark, monkeypatch):
    """Cells over all rows move the starts; the iterations over all rows are few, and settle as well."""
    rng = np.random.default_rng(8)
    x = rng.random((6000, 2)) * [1.0, 1.3]
    df = spark.createDataFrame(x.tolist(), "a double, b double").repartition(3).persist()
    slow = SK.fit_all(df, 2, [6] * 4, [1, 2, 3, 4], 300, 1e-8)
    monkeypatch.setattr(SK, "GRID_ROWS", 1000)
    means, rows = SK._cells(df, 2)
    assert rows.sum() == 6000 and len(means) > 1000
    np.testing.assert_allclose((means * rows[:, None]).sum(axis=0), x.sum(axis=0))
    fast = SK.fit_all(df, 2, [6] * 4, [1, 2, 3, 4], 300, 1e-8, 6000)
    assert sum(f.iterations for f in fast) < sum(f.iterations for f in slow) / 2
    assert min(f.cost for f in fast) < 1.02 * min(f.cost for f in slow)
    for f in fast:  # a plain iteration does not move it
        again, cost, sizes = plain(x, f.centers, 1)
        assert ((again - f.centers) ** 2).sum() < 1e-6 and sizes.sum() == 6000
    assert SK._cells(df.selectExpr("a * 1e9 AS a", "0.0D AS b"), 2)[1].sum() == 6000


def test_packed_rows_are_the_rows(points):
    x, df = points
    blocks = SK.packed(df, 3).persist()
    assert blocks.count() < len(x)
    for a, b in zip(SK.fit_all(df, 3, [4, 2], [1, 2], 50, 1e-6), SK.fit_all(blocks, 3, [4, 2], [1, 2], 50, 1e-6)):
        np.testing.assert_allclose(a.centers, b.centers, atol=1e-9)
        assert a.sizes.tolist() == b.sizes.tolist()


def test_clusters_of_many_columns_are_filtered(spark):
    """A filter on the cluster of 64 columns filled the driver's heap: its constraints doubled with each column."""
    from tessera.operators.stats import crosstab
    rng = np.random.default_rng(8)
    x, label = rng.normal(size=(200, 64)) + 6 * rng.integers(0, 2, (200, 1)), rng.integers(0, 3, 200)
    df = (spark.createDataFrame([(r.tolist(), f"L{v}") for r, v in zip(x, label)], "v array<double>, label string")
          .selectExpr(*[f"v[{i}] AS e{i}" for i in range(64)], "label").repartition(4))
    res = K.fit_kmeans(df, [f"e{i}" for i in range(64)], 2, n_init=1, max_iter=5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    lab = ((z[:, None] - res.centers) ** 2).sum(axis=2).argmin(axis=1)
    got = {(r[0], r[1]): r[2] for r in crosstab(res.assign(df), "KMeans_Cluster", "label").collect()}
    assert got == {(f"Cluster {c + 1}", f"L{v}"): int(((lab == c) & (label == v)).sum()) for c in range(2) for v in range(3)}
