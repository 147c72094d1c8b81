import pandas as pd

from tessera.functions import ranking as RK
from tessera.operators import metrics as M
from tessera.operators import stats as S


def test_crosstab_of_many_levels(spark, monkeypatch):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, 'hot', concat('a', id % 50)) AS p", "cast(id * id % 37 AS int) AS q")
    want = pd.crosstab(*[df.toPandas()[c] for c in ("p", "q")])
    for size in (1000, 4):
        monkeypatch.setattr(RK, "GRID", size)
        got = {(r["p"], r["q"]): r["count"] for r in S.crosstab(df, "p", "q").collect()}
        assert got == {(p, q): n for q, column in want.items() for p, n in column.items()}
    assert S.crosstab(df.limit(0), "p", "q").count() == 0


def test_confusion_of_many_classes(spark):
    df = spark.range(1100).selectExpr("concat('c', id) AS label", "concat('c', if(id % 10 = 0, 0, id)) AS prediction")
    got = M.confusion(df)
    assert got.count() == 1100 ** 2
    assert got.where("n > 0").count() == 1100 and got.where("n > 0 AND actual != predicted").count() == 109
