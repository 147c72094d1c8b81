"""Label model, classifier and scores."""

import zlib

import numpy as np
import pytest

from tessera.llm import toxicity as tx


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels, tx.score(docs, tx.train(docs, labels)).toPandas()


def test_held_out_accuracy(scored):
    docs, labels, got = scored
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    x = labels.toPandas().merge(got, on="doc_id")
    x = x[x.held_out]
    p, n = x[x.toxic == 1].score.values, x[x.toxic == 0].score.values
    auc = (p[:, None] > n).mean() + (p[:, None] == n).mean() / 2
    assert auc > 0.95
    assert (x.predicted[x.toxic == 0]).mean() < 0.02 and (x.predicted[x.toxic == 1]).mean() > 0.7


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = (tx.train(docs, x) for x in (labels, flipped))
    assert one.weights == two.weights and one.bias == two.bias


def test_label_model_discounts_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    base = np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.05)
    other = np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.1)
    votes = np.stack([base, base, base, other, ~(base | other)], axis=1).astype(float)
    model = tx.LabelModel(5, 0)
    for _ in range(8):
        p = model.posterior(votes, [bool(t) if i % 3 else None for i, t in enumerate(y)])
        n = np.array([(1 - p).sum(), p.sum()])
        model.update(n, np.stack([votes.T @ (votes * (1 - p)[:, None]), votes.T @ (votes * p[:, None])]))
    assert abs(model.on[1, 0] - 0.6) < 0.08 and abs(model.on[0, 0] - 0.05) < 0.04 and abs(model.prior - 0.2) < 0.05
    assert model.weight[0] < 0.5 < model.weight[3]


def test_rare_telling_words_beside_many_common_ones(spark):
    rng = np.random.default_rng(4)
    common = " ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (9000, 10)))
    rows = [(common + (" zzvile" if i < 3 else ""), True) for i in range(4)] + [(common, False)] * 20
    sample = spark.createDataFrame(rows, "text string, toxic boolean").repartition(4)
    assert len({f for w in tx.words_of(common) for f in tx.features_of(w)}) > 60_000
    assert b"zzvile=" in tx.mine(sample)


def test_edge_cases(spark):
    long = "fine words " * 30_000
    rows = [(1, "you are a stupid idiot, moron", 1), (2, None, 1), (3, "", 0), (None, "nice", 0), (4, "nice words", 0), (4, "nice words", 0), (5, long, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for labels in (spark.createDataFrame([], "doc_id long, toxic int"),
                   spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")):
        model = tx.train(docs, labels)
        got = tx.score(docs, model).toPandas()
        assert len(got) == len(rows) and got.score.between(0, 1).all() and got.held_out.notna().all()
        empty = got[got.doc_id.isin([2, 3])].score
        assert empty.nunique() == 1 and got[got.doc_id == 1].score.iloc[0] > empty.iloc[0]
        kept = tx.drop_toxic(docs, model)
        assert kept.columns == docs.columns and kept.count() == (got.score < 0.3).sum()
    assert tx.score(docs.limit(0), model).count() == 0
    assert isinstance(tx.train(docs.limit(0), labels), tx.Classifier)
