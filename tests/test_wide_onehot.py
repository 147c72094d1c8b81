import numpy as np

from tessera.operators import preprocess as R
from tessera.operators.wide_onehot import fit_wide_onehot


def rows(spark, n=6000):
    # a level of a third of the rows, 3,000 rare ones, a clashing column name
    return spark.range(n).selectExpr("id", "if(id % 3 = 0, 'hot', concat('v', id % 3000)) AS a", "if(id % 5 = 0, NULL, id % 4) AS b", "id AS __code0")


def test_places_and_vectors(spark):
    df = rows(spark)
    got = fit_wide_onehot(df, ["a", "b"])
    pdf = df.toPandas()
    levels = sorted(set(pdf.a))
    assert got.widths == [len(levels), 5] and got.size == len(levels) + 5
    table = got.dictionary().toPandas().sort_values("place")
    assert list(table.place) == list(range(got.size))
    assert list(table.feature) == [f"a_{v}" for v in levels] + ["b_0", "b_1", "b_2", "b_3", "b_nan"]
    want = {r.id: [levels.index(r.a), len(levels) + (4 if np.isnan(r.b) else int(r.b))] for r in pdf.itertuples()}
    placed = got.places(df)
    assert placed.columns == ["id", "__code0", "onehot"]
    assert {r["id"]: r["onehot"] for r in placed.collect()} == want
    vectors = {r["id"]: r["onehot"] for r in got.transform(df).collect()}
    assert {k: list(v.indices) for k, v in vectors.items()} == want
    assert all(len(v) == got.size and set(v.values) == {1.0} for v in vectors.values())


def test_unknown_levels_and_empty_tables(spark):
    got = fit_wide_onehot(rows(spark, 40), ["a", "b"])
    new = spark.createDataFrame([(1, "hot", 0), (2, "never", 1), (3, None, None)], "id long, a string, b long")
    assert [r.onehot for r in got.places(new).orderBy("id").collect()] == [[0, got.widths[0]], [got.widths[0] + 1], [got.size - 1]]
    assert [len(r.onehot.indices) for r in got.transform(new).orderBy("id").collect()] == [2, 1, 1]
    assert got.places(new.limit(0)).count() == 0
    none = fit_wide_onehot(new.limit(0), ["a"])
    assert none.size == 0 and [r.onehot for r in none.places(new).collect()] == [[], [], []]
    assert [len(r.onehot) for r in none.transform(new).collect()] == [0, 0, 0]


def test_preprocess_takes_a_wide_column(spark):
    df = rows(spark).selectExpr("cast(id AS double) AS x", "a", "cast(b AS string) AS b", "id % 2 AS t")
    got = R.preprocess(df, "t", remove_dups=False)
    assert got.columns == ["x", "b_0", "b_1", "b_2", "b_3", "onehot", "t"]
    first = got.first()
    assert len(first.onehot) == 2001 and len(first.onehot.indices) == 1 and got.count() == 6000
