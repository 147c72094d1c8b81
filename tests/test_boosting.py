import numpy as np
import pytest

from tessera.functions import linalg as L
from tessera.operators import boosting as B
from tessera.operators import models as MO


def grow(x, r, w, cuts, rows, depth):
    """Plain least-squares tree: [(rows, leaf sums)] from left to right."""
    if depth == 0:
        return [(rows, r[rows].sum(), w[rows].sum())]
    best = (1e-12, None, None)
    for j, c in enumerate(cuts):
        for b, cut in enumerate(c):
            left = rows[x[rows, j] <= cut]
            right = rows[x[rows, j] > cut]
            if len(left) and len(right):
                gain = r[left].sum() ** 2 / len(left) + r[right].sum() ** 2 / len(right) - r[rows].sum() ** 2 / len(rows)
                if gain > best[0] + 1e-9:
                    best = gain, left, right
    if best[1] is None:
        return [(rows, r[rows].sum(), w[rows].sum())]
    return grow(x, r, w, cuts, best[1], depth - 1) + grow(x, r, w, cuts, best[2], depth - 1)


def plain(x, y, classes, cuts, stages, depth=3, rate=0.1):
    f = np.tile(np.log([np.mean(y == k) for k in range(classes)]), (len(x), 1))
    for _ in range(stages):
        p, add = B.softmax(f), np.zeros_like(f)
        for k in range(classes):
            r = (y == k) - p[:, k]
            w = np.abs(r) * (1 - np.abs(r))
            for rows, num, den in grow(x, r, w, cuts, np.arange(len(x)), depth):
                add[rows, k] = rate * (classes - 1) / classes * num / den
        f += add
    return f


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = np.where(x[:, 0] ** 2 + x[:, 1] > 1, 2, (x[:, 1] * x[:, 2] > 0).astype(int))
    y[:40] = rng.integers(0, 3, 40)
    return x, y, spark.createDataFrame([(float(k), *map(float, r)) for k, r in zip(y, x)], "label double, __z0 double, __z1 double, __z2 double").repartition(3)


@pytest.mark.parametrize("direct", [4_000_000, 0])
def test_margins_against_plain_boosting(spark, table, direct, monkeypatch):
    monkeypatch.setattr(L, "DIRECT", direct)
    monkeypatch.setattr(B, "REFRESH", 2)  # margins are written in between
    x, y, df = table
    cuts = [np.quantile(x[:, j], np.arange(1, 12) / 12) for j in range(3)]
    model = B.fit_boosted(df, 3, 3, stages=5, cuts=cuts)
    np.testing.assert_allclose(model.margins(x), plain(x, y, 3, cuts, 5), atol=1e-8)
    got = model.predict(df, 3).toPandas()
    assert (got.prediction == model.margins(got[["__z0", "__z1", "__z2"]].to_numpy()).argmax(axis=1)).all()


def test_learns_and_small_inputs(spark, table):
    x, y, df = table
    model = B.fit_boosted(df, 3, 3, stages=20)
    assert (model.margins(x).argmax(axis=1) == y).mean() > 0.9
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (0.0, 2.0)], "label double, __z0 double")
    flat = B.fit_boosted(one, 1, 3, stages=2)  # a constant column, a class without rows
    assert flat.margins(np.array([[2.0]])).argmax() == 1
    with pytest.raises(ValueError, match="no rows"):
        B.fit_boosted(one.limit(0), 1, 2)


def test_in_the_comparison(spark):
    df = spark.range(200).selectExpr("id", "cast(id % 10 as double) AS a", "cast(id % 7 as double) AS b", "if(id % 10 > 4, 'x', if(id % 7 > 3, 'y', 'z')) AS t")
    table, best, pred = MO.compare_models(df, "t", ["a", "b"], ["gradient_boosting"], key=["id"])
    assert table.first().test_accuracy == 1.0 and best == "gradient_boosting" and pred.count() == 40


def test_equal_bin_numbers_are_one_row(spark, monkeypatch):
    """Passes read counted rows: no more than labels x bins, however many rows there are."""
    seen, pass_ = [], B._histograms

    def counted(stages, tree, level, d, classes, bins):
        run = pass_(stages, tree, level, d, classes, bins)

        def few(batches):
            def small():
                for b in batches:
                    assert b.num_rows <= 2 * 4 * 4
                    yield b
            return run(small())
        seen.append(level)
        return few
    monkeypatch.setattr(B, "_histograms", counted)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=4000) > 0).astype(int)
    df = spark.createDataFrame([(float(k), *map(float, r)) for k, r in zip(y, x)], "label double, __z0 double, __z1 double").repartition(4)
    cuts = [np.quantile(x[:, j], [0.25, 0.5, 0.75]) for j in range(2)]
    model = B.fit_boosted(df, 2, 2, stages=3, cuts=cuts)
    assert len(seen) == 9
    np.testing.assert_allclose(model.margins(x), plain(x, y, 2, cuts, 3), atol=1e-8)
