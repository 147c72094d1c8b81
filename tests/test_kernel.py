import numpy as np
import pytest

from tessera.operators import kernel as KE
from tessera.operators import models as MO

COLS = ["a", "b"]


def frame(spark, x, parts=4):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in COLS[:x.shape[1]])).repartition(parts)


def plain(x, y, gamma):
    return np.exp(-gamma * ((x[:, None, :] - y[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize("bound", [0.05, 1e-6])
def test_every_kernel_is_within_the_residuals(spark, bound):
    x = np.random.default_rng(0).normal(size=(700, 2))
    got = KE.fit_kernel(frame(spark, x), COLS, bound=bound, first=8)
    assert got.holds and got.gamma == pytest.approx(1 / (2 * x.var())) and len(got.landmarks) < 400
    f = got.features(x)
    r = 1 - (f * f).sum(axis=1)
    assert r.mean() == pytest.approx(got.mean_residual, abs=1e-9) and r.max() == pytest.approx(got.max_residual, abs=1e-9)
    assert r.mean() <= bound
    wrong = np.abs(plain(x, x, got.gamma) - f @ f.T)
    assert (wrong <= np.sqrt(np.outer(r.clip(0), r.clip(0))) + 1e-8).all()
    # landmarks themselves have their kernels
    marks = got.landmarks
    assert np.allclose(got.features(marks) @ f.T, plain(marks, x, got.gamma), atol=1e-4)


def test_fewer_landmarks_do_not_grow_with_the_rows(spark):
    rng = np.random.default_rng(1)
    sizes = [len(KE.fit_kernel(frame(spark, rng.uniform(size=(n, 2))), COLS, gamma=2.0, first=8).landmarks) for n in (300, 6000)]
    assert sizes[1] <= 2 * sizes[0]


def test_ending_at_the_most_is_told(spark):
    x = np.random.default_rng(2).normal(size=(300, 2)) * 100
    got = KE.fit_kernel(frame(spark, x), COLS, gamma=1.0, first=8, most=20)
    assert not got.holds and len(got.landmarks) == 20 and got.mean_residual > 0.5


def test_copies_constants_and_no_rows(spark):
    x = np.repeat(np.array([[1.0, 2.0], [3.0, -1.0]]), [3000, 5], axis=0)
    got = KE.fit_kernel(frame(spark, x), COLS, bound=1e-9, first=2)
    assert got.holds and len(got.landmarks) == 2
    assert len(KE.fit_kernel(frame(spark, np.ones((50, 2))), COLS).landmarks) == 1
    with pytest.raises(ValueError, match="no rows"):
        KE.fit_kernel(frame(spark, x).limit(0), COLS)


def test_rings(spark):
    rng = np.random.default_rng(3)
    angle, ring = rng.uniform(0, 2 * np.pi, 400), rng.integers(0, 3, 400)
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1) * (ring + 1)[:, None] + rng.normal(0, 0.08, (400, 2))
    df = spark.createDataFrame([(i, float(p), float(q), f"ring{k}") for i, ((p, q), k) in enumerate(zip(x, ring))], "id long, a double, b double, t string")
    svm, best, pred = MO.compare_models(df, "t", COLS, ["svm"], key=["id"])
    line = MO.compare_models(df, "t", COLS, ["logistic"], key=["id"])[0].first()
    assert svm.first().test_accuracy >= 0.97 > line.test_accuracy + 0.2 and best == "svm" and pred.count() == 80


def test_kernel_means(spark):
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=(500, 2)), rng.integers(0, 3, 500)
    df = spark.createDataFrame([(float(p), None if i == 7 else float(q), None if i < 5 else f"g{k}")
                                for i, ((p, q), k) in enumerate(zip(x, g))], "a double, b double, g string")
    got = {(r.a, r.b): r.mean_kernel for r in KE.kernel_means(df, COLS, "g", gamma=0.5).collect()}
    x[7, 1] = np.delete(x[:, 1], 7).mean()
    z = ((x - x.mean(axis=0)) / x.std(axis=0))[5:]
    k = plain(z, z, 0.5)
    for i in range(3):
        for j in range(i, 3):
            assert got[f"g{i}", f"g{j}"] == pytest.approx(k[np.ix_(g[5:] == i, g[5:] == j)].mean(), abs=1e-5)
    assert len(got) == 6 and KE.kernel_means(df.limit(0), COLS, "g").count() == 0


def test_merged_rows_fit_as_all_rows(spark, monkeypatch):
    """Equal train rows go into a fit once, with their number; predictions are those of all rows."""
    rng = np.random.default_rng(5)
    angle, ring = rng.uniform(0, 2 * np.pi, 60), rng.integers(0, 2, 60)
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1).round(1) * (2 * ring + 1)[:, None]
    many = np.repeat(np.arange(60), rng.integers(2, 12, 60))
    df = spark.createDataFrame([(i, float(x[j, 0]), float(x[j, 1]), f"ring{ring[j]}") for i, j in enumerate(many)], "id long, a double, b double, t string")
    sizes, plain = [], MO.estimator

    def short(name, n, *a):
        sizes.append(n)
        found = plain(name, n, *a)
        found.getClassifier().setMaxIter(20)
        return found
    monkeypatch.setattr(MO, "estimator", short)
    want = MO.compare_models(df, "t", COLS, ["svm"], key=["id"])[0].first()
    monkeypatch.setattr(MO, "MERGE_ROWS", 0)
    seen, fit = [], MO.OneVsRest.fit
    monkeypatch.setattr(MO.OneVsRest, "fit", lambda self, rows: seen.append((self.getWeightCol(), rows.count())) or fit(self, rows))
    got = MO.compare_models(df, "t", COLS, ["svm"], key=["id"])[0].first()
    assert sizes[0] == sizes[1] and got.test_accuracy == pytest.approx(want.test_accuracy, abs=0.02) and got.test_accuracy > 0.9
    assert seen == [("weight", min(seen[0][1], 60))]


def test_features_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(300, 2))
    df = frame(spark, x, 2)
    found = KE.fit_kernel(df, COLS)
    monkeypatch.setattr(KE, "BLOCK", 7 * len(found.landmarks))
    assert [len(p) for p in found.blocks(x[:16])] == [7, 7, 2]
    got = found.transform(df, COLS, "f").collect()
    assert len(got) == 300 and np.allclose([r.f for r in got], found.features(np.array([[r.a, r.b] for r in got])))
