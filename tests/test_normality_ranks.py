import math
import statistics

import numpy as np
import pytest

from tessera.operators import normality as N


def plain(x):
    x = np.sort(x)
    n = len(x)
    m = np.array([statistics.NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    w = np.corrcoef(x, m)[0, 1] ** 2
    u, v = math.log(n), math.log(math.log(n))
    z = (math.log(1 - w) - (-1.2725 + 1.0521 * (v - u))) / (1.0308 - 0.26758 * (v + 2 / u))
    return w, z, 0.5 * math.erfc(z / math.sqrt(2))


def test_scores():
    p = np.concatenate([np.linspace(1e-9, 1 - 1e-9, 5001), [1e-300, 1e-30, 1e-12]])
    want = [statistics.NormalDist().inv_cdf(float(t)) for t in p]
    np.testing.assert_allclose(N.normal_scores(p), want, rtol=1e-13, atol=1e-13)


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_against_numpy(spark, monkeypatch, block):
    """Ties of a third of all rows, in one block and in many."""
    monkeypatch.setattr(N, "RANKS", block)
    rng = np.random.default_rng(1)
    n = 900
    cols = {"g": rng.normal(5, 2, n), "e": rng.exponential(size=n), "t": np.where(rng.random(n) < 0.34, 1.0, rng.normal(size=n)),
            "k": np.full(n, 3.0), "some": np.where(np.arange(n) < 896, np.nan, 1.0)}
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in cols.values()])), ", ".join(f"{c} double" for c in cols))
    got = {r.column: r for r in N.shapiro_francia(df).collect()}
    assert set(got) == {"g", "e", "t", "k"}  # a column of four values is left out
    for c in "get":
        w, z, p = plain(cols[c])
        assert (got[c].n, got[c].w, got[c].z, got[c].p_value) == (n, pytest.approx(w, abs=1e-6), pytest.approx(z, abs=1e-3), pytest.approx(p, abs=1e-5))
    assert got["g"].normal and not got["e"].normal and got["k"].w is None and not got["k"].normal
    assert N.shapiro_francia(df.limit(0)).count() == 0


def test_scores_are_added_up_by_column(monkeypatch):
    """Many values a call, not one: a batch gives a row a column and block of ranks."""
    import pyarrow as pa
    calls, scores = [], N.normal_scores
    monkeypatch.setattr(N, "normal_scores", lambda p: calls.append(len(p)) or scores(p))
    monkeypatch.setattr(N, "RANKS", 40)
    rng = np.random.default_rng(3)
    count = np.where(np.arange(90) == 50, 60, rng.integers(1, 4, 90))
    first = np.cumsum(count) - count + 1
    c, x, n = np.repeat([0, 1], 45).astype(np.int32), rng.normal(size=90), int(count.sum())
    batch = pa.RecordBatch.from_arrays([pa.array(c), pa.array(x), pa.array(np.full(90, n)), pa.array(first), pa.array(first + count - 1)],
                                       names=["c", "x", "n", "first", "last"])
    got = pa.Table.from_batches(N._add_scores([batch])).to_pandas().groupby("c").sum()
    m = scores((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    for k in (0, 1):
        mine = np.repeat(c, count) == k
        assert got.xm[k] == pytest.approx((np.repeat(x, count) * m)[mine].sum()) and got.mm[k] == pytest.approx((m[mine] ** 2).sum())
    assert sum(calls) == n and len(calls) < 20
