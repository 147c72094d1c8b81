"""Poisson counts against a plain inversion."""

import hashlib
import math

import pytest

from tessera.llm import poisson_mix as pm
from tessera.llm import queries


def uniform(*parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) / (1 << 52)


def inverse(mean, u):
    k, term = 0, math.exp(-mean)
    cdf = term
    while cdf <= u:
        k += 1
        term *= mean / k
        cdf += term
    return k


def count(rate, doc):
    pieces = max(1, math.ceil(rate / pm.PIECE))
    return sum(inverse(rate / pieces, uniform("42", "" if doc is None else str(doc), str(j))) for j in range(pieces)) if rate else 0


def test_counts_and_edge_cases(spark):
    rows = [(i, "t", "big" if i % 3 else "small", 1) for i in range(300)] + [(None, None, None, 2), (5, "again", "big", 3), (900, "", "rare", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    weights = spark.createDataFrame([("big", 0.1), ("small", 0.3), (None, 0.01), ("rare", 4.0), ("absent", 0.5)], "source string, weight double")
    n = {s: sum(r[2] == s for r in rows) for s in ("big", "small", None, "rare")}
    w = {"big": 0.1, "small": 0.3, None: 0.01, "rare": 4.0}
    want = []
    for r in rows:
        if r[0] is None:  # drawn by text and row number, see below
            continue
        rate = w[r[2]] * len(rows) / n[r[2]]
        k = count(rate, r[0])
        want += [(r[0], r[1], r[2], k, c) for c in range(k)]
    mixed = pm.mix(df, weights)
    got = [(r.doc_id, r.text, r.source, r.n_copies, r.copy) for r in mixed.collect() if r.doc_id is not None]
    assert sorted(map(str, got)) == sorted(map(str, want))
    rare = [g for g in got if g[2] == "rare"]
    assert abs(len(rare) - 4.0 * len(rows)) < 6 * math.sqrt(4.0 * len(rows))  # a rate above one piece
    assert len({(r.doc_id, r.copy) for r in mixed.collect()}) > 50


def test_rows_without_id_are_drawn_and_spread_singly(spark, tmp_path):
    hot = next(i for i in range(1, 100) if count(1.0, i) == 1)
    df = spark.range(9000).selectExpr(f"if(id % 3 = 0, NULL, if(id % 3 = 1, {hot}, id)) AS doc_id",
                                      "if(id % 2 = 0, 'same', cast(id as string)) AS text", "'s' AS source", "id AS line")
    df.write.parquet(f"{tmp_path}/d")
    w = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    mixed = pm.mix(spark.read.parquet(f"{tmp_path}/d"), w)
    rows = mixed.collect()
    counts = {r.line: r.n_copies for r in rows if r.doc_id is None}
    n = [counts.get(i, 0) for i in range(0, 9000, 3)]
    mean = sum(n) / len(n)
    assert abs(mean - 1) < 0.1 and abs(sum((x - mean) ** 2 for x in n) / len(n) - 1) < 0.15 and set(n) >= {0, 1, 2, 3}
    assert len({r.n_copies for r in rows if r.doc_id == hot}) == 1  # one id, one count
    sizes = [r["count"] for r in mixed.groupBy(pm.F.spark_partition_id()).count().collect()]
    again = {(r.line, r.copy) for r in pm.mix(spark.read.parquet(f"{tmp_path}/d"), w).collect()}
    assert max(sizes) < 1.5 * len(rows) / max(len(sizes), 1) and again == {(r.line, r.copy) for r in rows}


def test_order_is_shuffled_and_stable(spark):
    df = spark.range(500).selectExpr("id as doc_id", "'t' as text", "'s' as source")
    w = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    one, two = ([(r.doc_id, r.shuffle_key) for r in pm.mix(df, w).collect()] for _ in range(2))
    assert one == two and [d for d, _ in one] != sorted(d for d, _ in one)


def test_no_weight_no_rows_and_errors(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "b", "t")], "doc_id long, text string, source string")
    none = spark.createDataFrame([("s", 0.0), ("t", None)], "source string, weight double")
    assert pm.mix(df, none).count() == 0
    assert pm.mix(df.limit(0), none).count() == 0
    with pytest.raises(Exception, match="negative weight"):
        pm.mix(df, spark.createDataFrame([("s", -1.0)], "source string, weight double")).count()


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(i, "s", i, i, i, i) for i in range(20)],
                               "doc_id long, source string, rate long, cdf long, pieces long, weight long")
    got = pm.mix(df, spark.createDataFrame([("s", 1.0)], "source string, weight double"))
    assert got.columns == ["doc_id", "source", "cdf", "pieces", "weight", "n_copies", "rate", "copy", "shuffle_key"]
    assert all(r.cdf == r.pieces == r.weight == r.doc_id and r.rate == 1.0 for r in got.collect())


def test_tempered_weights(spark):
    df = spark.createDataFrame([(i, "s" if i < 90 else "t") for i in range(100)], "doc_id long, source string")
    got = {r.source: r.weight for r in pm.tempered_weights(df).collect()}
    assert got["s"] / got["t"] == pytest.approx(3) and sum(got.values()) == pytest.approx(1)


def test_query_moves_whole_documents(spark, monkeypatch, tmp_path):
    path, sf = str(tmp_path / "mixed"), "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "scratch_path", lambda *_: path)
    got = sorted((r.doc_id, r.copy, r.n_copies) for r in queries.op6_poisson_mix(spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = spark.read.parquet(path)
    assert set(docs.columns) <= set(mixed.columns)
    assert got == sorted((r.doc_id, r.copy, r.n_copies) for r in mixed.collect())
    want = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == want[r.doc_id] for r in mixed.collect())
