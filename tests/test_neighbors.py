"""k-nearest-neighbour classifier (M8) against a numpy brute force."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import models as MO
from tessera.operators.neighbors import knn_predict


def _brute(train_x, train_y, query_x, k):
    out = []
    for q in query_x:
        d2 = ((train_x - q) ** 2).sum(1)
        order = np.lexsort((train_y, d2))[:k]
        labs = train_y[order]
        vals, counts = np.unique(labs, return_counts=True)
        out.append(vals[np.argmax(counts)])          # np.unique sorts: smallest label wins ties
    return np.array(out)


def _frame(spark, x, y, split):
    d = x.shape[1]
    pdf = pd.DataFrame({f"__z{i}": x[:, i] for i in range(d)})
    pdf["label"] = y.astype(float)
    pdf["split"] = split
    pdf["rid"] = np.arange(len(pdf))
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("d,dup", [(1, False), (2, True), (5, True), (12, False)])
def test_knn_matches_brute_force(spark, d, dup):
    rng = np.random.default_rng(d)
    n = 400
    x = rng.integers(-20, 20, size=(n, d)).astype(float)
    x[: n // 3 if dup else 0] = 3.0                      # a third of the rows on one vector
    y = rng.integers(0, 3, size=n)
    split = np.where(rng.random(n) < 0.25, "test", "train")
    df = _frame(spark, x, y, split)
    got = knn_predict(df, d, k=5).select("rid", "prediction").toPandas().sort_values("rid")
    tr = split == "train"
    want = _brute(x[tr], y[tr], x, 5)
    assert len(got) == n
    assert np.array_equal(got["prediction"].to_numpy().astype(int), want)


def test_knn_fewer_train_rows_than_k(spark):
    x = np.array([[0.0], [1.0], [5.0], [6.0]])
    y = np.array([0, 1, 1, 0])
    df = _frame(spark, x, y, np.array(["train", "train", "train", "test"]))
    got = knn_predict(df, 1, k=5).select("rid", "prediction").toPandas().sort_values("rid")
    assert got["prediction"].tolist() == [1.0, 1.0, 1.0, 1.0]


def test_compare_models_knn(lineitem):
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    table, best, pred = MO.compare_models(lineitem, "l_returnflag", feats, ["knn"],
                                          key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    rows = table.collect()
    assert [r["model"] for r in rows] == ["K-Nearest Neighbors"]
    assert 0 <= rows[0]["test_accuracy"] <= 1 and rows[0]["train_accuracy"] >= rows[0]["test_accuracy"] - 0.2
    n = lineitem.where("l_returnflag IS NOT NULL").count()
    assert best == "knn" and pred.count() == -(-n // 5)          # every test row predicted once


@pytest.mark.parametrize("d,kind", [(1, "grid"), (3, "grid"), (2, "even"), (9, "even"), (2, "one")])
def test_boxes_vote_as_all_rows(monkeypatch, d, kind):
    """Near boxes decide as all fitted rows do, on far fewer distances where columns are few."""
    from tessera.operators import neighbors as NB
    rng = np.random.default_rng(d)
    make = {"grid": lambda n: rng.integers(-9, 9, (n, d)).astype(float), "even": lambda n: rng.random((n, d)) * 1e3,
            "one": lambda n: np.where(rng.random((n, 1)) < 0.9, 2.0, rng.normal(size=(n, d)))}[kind]
    rows = np.column_stack([make(3000), rng.integers(0, 4, 3000)])
    units, copies = np.unique(rows, axis=0, return_counts=True)
    vectors, labels, copies = units[:, :d], units[:, d], np.minimum(copies, 5)
    x = np.concatenate([make(700), vectors[:200], np.full((3, d), 1e6)])
    want = NB.vote(x, vectors, labels, copies, 5)
    looked, plain = [], NB.vote
    monkeypatch.setattr(NB, "vote", lambda q, v, *a: looked.append(len(q) * len(v)) or plain(q, v, *a))
    assert np.array_equal(NB.Boxes.of(vectors, labels, copies, 5).vote(x), want)
    if (d, kind) == (2, "even"):
        assert sum(looked) < 0.7 * len(x) * len(vectors)


@pytest.mark.parametrize("d,kind", [(1, "grid"), (3, "grid"), (4, "even"), (9, "even"), (2, "apart"), (2, "one")])
def test_many_fitted_rows_in_leaves(spark, monkeypatch, d, kind):
    """All train rows are fitted, however many: the leaves vote as a brute force does."""
    from tessera.operators import neighbors as NB
    monkeypatch.setattr(NB, "MARKS", 8)
    monkeypatch.setattr(NB, "LEAF", 20)
    monkeypatch.setattr(NB, "ASKED", 50)
    rng = np.random.default_rng(d)
    n = 900
    x = {"grid": rng.integers(-4, 4, (n, d)).astype(float), "even": rng.random((n, d)), "apart": rng.normal(size=(n, d)),
         "one": np.where(rng.random((n, 1)) < 0.8, 2.0, rng.normal(size=(n, d)))}[kind]
    y = rng.integers(0, 4, size=n)
    split = np.where(rng.random(n) < 0.25, "test", "train")
    if kind == "apart":  # test rows where no fitted row is near, fewer fitted rows than leaves in places
        split = np.where(x[:, 0] > 0.3, "test", "train")
        x[split == "test"] += 40
    got = NB.knn_predict(_frame(spark, x, y, split), d, k=5, few=0).select("rid", "prediction").toPandas().sort_values("rid")
    tr = split == "train"
    assert np.array_equal(got["prediction"].to_numpy().astype(int), _brute(x[tr], y[tr], x, 5))


def test_fewer_fitted_rows_than_k_in_leaves(spark):
    x = np.array([[0.0], [1.0], [5.0], [6.0]])
    df = _frame(spark, x, np.array([0, 1, 1, 0]), np.array(["train", "train", "train", "test"]))
    got = knn_predict(df, 1, k=5, few=0).select("rid", "prediction").toPandas().sort_values("rid")
    assert got["prediction"].tolist() == [1.0, 1.0, 1.0, 1.0]


def test_all_train_rows_are_fitted(spark):
    """A class beyond the first hundred thousand rows of any order has its votes."""
    n = 130_000
    df = spark.range(0, n, 1, 8).selectExpr("CAST(id AS DOUBLE) AS __z0", "CAST(id AS DOUBLE) AS label", "'train' AS split", "id AS rid")
    assert knn_predict(df, 1, k=1).where("prediction != rid").count() == 0
