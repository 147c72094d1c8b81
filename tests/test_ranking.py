"""Total order of any columns, cuts and quantiles per group; no limit on groups."""

import collections
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

from tessera.functions import ranking as RK
from tessera.operators import charts as C
from tessera.operators import stats as S
from tessera.operators.split import train_test_split


def test_positions_of_mixed_columns(spark):
    df = spark.range(3000).selectExpr("cast(id * 7919 % 61 as string) AS s", "if(id % 9 = 0, NULL, id % 5) AS i", "id % 4 AS w")
    got = RK.positions(df, [RK.F.col("s"), RK.F.col("i").desc_nulls_last()], "w").orderBy("__before").collect()
    key = [(r.s, r.i is None, -(r.i or 0)) for r in got]
    assert key == sorted(key) and len(got) == 3000
    ends = sorted((r["__before"], r["__before"] + r.w) for r in got)
    assert ends[0][0] == 0 and all(a[1] >= b[0] for a, b in zip(ends, ends[1:])) and max(e for _, e in ends) == sum(r.w for r in got)


@pytest.mark.parametrize("reach", [0.003, -0.2])
def test_grouped_quantiles(spark, monkeypatch, reach):
    """A hot group and a hot value beside thousands of small groups; with brackets
    that miss every rank (negative reach) the second round settles all."""
    monkeypatch.setattr(RK, "REACH", reach)
    rng = np.random.default_rng(0)
    n = 30_000 if reach > 0 else 2000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, -1, rng.integers(0, 15_000 if reach > 0 else 300, n)), "h": rng.choice(["a", "b"], n),
                        "x": np.where(rng.random(n) < 0.3, 5.0, rng.normal(size=n)), "y": rng.integers(0, 3, n).astype(float)})
    pdf.loc[rng.random(n) < 0.1, "x"] = np.nan
    df, probs = spark.createDataFrame(pdf), [0.0, 0.25, 0.5, 0.9, 1.0]
    for by in (["g"], ["h", "g"]):
        got = RK.grouped_quantiles(df, by, ["x", "y"], probs).toPandas().set_index(by).sort_index()
        want = pdf.groupby(by)[["x", "y"]].quantile(probs).unstack()
        for i, c in enumerate(["x", "y"]):
            for j, p in enumerate(probs):
                np.testing.assert_allclose(got[f"q{i}_{j}"].astype(float), want[(c, p)].reindex(got.index), atol=1e-12)
            assert got[f"n{i}"].sum() == pdf[c].count()


def test_boxes_of_many_groups(spark):
    df = spark.range(16_000).selectExpr("if(id < 1000, -1, id div 2) AS g", "cast(id * 31 % 101 as double) AS v")
    got = {r.g: r for r in C.box_stats(df, "v", "g").collect()}
    p = df.toPandas().groupby("g").v
    assert len(got) == p.ngroups > 5000
    for g, q in p.quantile([0.25, 0.5, 0.75]).unstack().sample(50, random_state=1).iterrows():
        assert [got[g].q1, got[g].median, got[g].q3] == pytest.approx(q.tolist())
    assert got[-1].n == 1000 and got[-1].whisker_lo == 0 and got[-1].n_outliers == 0
    assert C.violin_outliers(df, "v", "g").count() == 0
    empty = C.box_stats(df.limit(0), "v").collect()
    assert [(r.n, r.q1, r.n_outliers) for r in empty] == [(0, None, 0)]


def test_split_by_long_text(spark):
    df = spark.range(100).selectExpr("concat('https://www.example.com/a/common/prefix/', lpad(cast(id as string), 4, '0')) AS url")
    got = train_test_split(df, 0.2, shuffle=False, order_by="url").where("split = 'test'").collect()
    assert sorted(r.url[-4:] for r in got) == [f"{i:04d}" for i in range(80, 100)]


def test_split_of_six_thousand_classes(spark):
    df = spark.range(18_006).selectExpr("id", "if(id >= 18000, -1, id div 3) AS c")
    got = train_test_split(df, 1 / 3, key=["id"], stratify="c").toPandas()
    test = got[got.split == "test"]
    assert len(got) == 18_006 and len(test) == 6002
    assert set(test.groupby("c").id.count()) == {1, 2} and (test.c == -1).sum() == 2


def test_split_of_nested_and_equal_rows(spark):
    df = spark.range(600).selectExpr("named_struct('a', id % 2, 'b', array(id % 3)) AS s", "map('k', id % 2) AS m", "if(id % 5 = 0, NULL, 'x') AS t",
                                     "cast(if(id % 7 = 0, 'NaN', '1') as double) AS d")
    for args in ({}, {"stratify": "t"}, {"shuffle": False, "order_by": "s"}, {"shuffle": False, "order_by": "d", "stratify": "t"}):
        got = train_test_split(df, 0.3, **args).collect()
        assert collections.Counter(r.split for r in got) == {"test": 180, "train": 420}
        rows = collections.Counter(str((r.s, r.m, r.t, r.d)) for r in got)
        assert rows == collections.Counter(str((r.s, r.m, r.t, r.d)) for r in df.collect())
        if "stratify" in args:
            assert sum(r.t is None for r in got if r.split == "test") == 36


def test_grouped_stats_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "BAND_LIMIT", 100)
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id % 40) AS k", "cast(id * id % 97 as double) AS v", "cast(id % 11 as double) AS w")
    got = S.grouped_stats(df, "k", ["v", "w"]).toPandas().set_index("k").sort_index()
    want = df.toPandas().groupby("k")[["v", "w"]].agg(["mean", "std", "median"])
    for c in ("v", "w"):
        for s in ("mean", "std", "median"):
            np.testing.assert_allclose(got[f"{c}_{s}"], want[(c, s)], atol=6e-4)


def test_a_session_that_names_no_folder(tmp_path):
    """A plain local session, its configuration empty, runs what writes."""
    code = ("from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "from tessera.operators.split import train_test_split\n"
            "print('rows', train_test_split(s.range(50), 0.2).where(\"split = 'test'\").count())\n")
    import os
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": here}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert "rows 10" in done.stdout, done.stderr[-2000:]
