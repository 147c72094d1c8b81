"""Factor analysis.

Maximum-likelihood factor analysis by the SVD iteration on the d x d
covariance of the standardised features (the covariance comes from one
Spark Gramian pass), optional varimax / quartimax rotation, and factor
scores as linear Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, numeric_cols, pround
from tessera.functions.frames import multipass
from tessera.functions.linalg import Prepared, covariance, fix_signs, linear_columns, prepare, varimax_like

_ROT = {"varimax": 1.0, "quartimax": 0.0}


@dataclass
class FAModel:
    prep: Prepared
    loadings: np.ndarray      # d x k
    psi: np.ndarray           # noise variances
    mean: np.ndarray          # of the standardised features
    n_iter: int

    @property
    def k(self) -> int:
        return self.loadings.shape[1]

    def score_weights(self) -> np.ndarray:
        w = self.loadings.T                       # k x d
        wpsi = w / self.psi
        cov_z = np.linalg.inv(np.eye(self.k) + wpsi @ w.T)
        return wpsi.T @ cov_z                     # d x k

    def transform(self, df: DataFrame, keep: list[str] | None = None, prefix: str = "Factor_") -> DataFrame:
        keep = keep or []
        z = self.prep.columns(df)
        zc = [F.col(f"__z{i}") - F.lit(float(self.mean[i])) for i in range(len(z))]
        sc = linear_columns(zc, self.score_weights(), [f"{prefix}{j + 1}" for j in range(self.k)])
        return df.select(*[col(c) for c in keep], *z).select(*[col(c) for c in keep], *sc)


# Maximum likelihood by alternating a scaled eigenproblem and the uniquenesses
# (Barber 2012, algorithm 21.1), with the stopping rule and constants of
# scikit-learn's FactorAnalysis (BSD 3-clause licence).
def fit_fa(df: DataFrame, feats: list[str] | None = None, k: int = 3, rotation: str | None = "varimax",
           target: str | None = None, tol: float = 1e-2, max_iter: int = 1000) -> FAModel:
    feats = feats or [c for c in numeric_cols(df) if c != target]
    if len(feats) < 3:
        raise ValueError("factor analysis needs at least three features")
    if not 1 <= k < len(feats):
        raise ValueError(f"{len(feats)} features allow 1 to {len(feats) - 1} factors, not {k}")
    with multipass(df, feats) as work:
        prep = prepare(work, feats, True)
        n, mean, cov = covariance(work, prep.columns(work), len(feats))
    d = len(feats)
    var = np.diag(cov).copy()
    psi = np.ones(d)
    small = 1e-12
    llconst = d * np.log(2 * np.pi) + k
    old = -np.inf
    w = np.zeros((k, d))
    it = 0
    for it in range(1, max_iter + 1):
        sq = np.sqrt(psi) + small
        m = cov / np.outer(sq, sq)
        vals, vecs = np.linalg.eigh(m)
        order = np.argsort(vals)[::-1]
        vals, vecs = vals[order], vecs[:, order]
        s = np.clip(vals[:k], small, None)
        unexp = float(np.trace(m) - np.sum(vals[:k]))
        w = (np.sqrt(np.clip(s - 1.0, 0, None))[:, None] * vecs[:, :k].T) * sq
        ll = -n / 2 * (llconst + np.sum(np.log(s)) + unexp + np.sum(np.log(psi)))
        if ll - old < tol:
            break
        old = ll
        psi = np.clip(var - np.sum(w ** 2, axis=0), small, None)
    load = w.T
    if rotation:
        if rotation not in _ROT:
            raise ValueError(f"unknown rotation {rotation}")
        load = varimax_like(load, _ROT[rotation])
    return FAModel(prep, fix_signs(load), psi, mean, it)


def fa_tables(df: DataFrame, feats=None, k: int = 3, rotation: str | None = "varimax", target=None) -> dict:
    """Loadings (feature x Factor i, r4), communalities (variable,
    communality r4, desc) and variance (factor, ss_loadings r4,
    pct_variance r2, cumulative_pct r2)."""
    m = fit_fa(df, feats, k, rotation, target)
    spark = df.sparkSession
    feats = m.prep.feats
    load = spark.createDataFrame([[f] + [pround(m.loadings[i, j], 4) for j in range(m.k)]
                                  for i, f in enumerate(feats)],
                                 "feature string, " + ", ".join(f"Factor_{j + 1} double" for j in range(m.k)))
    comm = np.sum(m.loadings ** 2, axis=1)
    comm_df = spark.createDataFrame([(f, pround(comm[i], 4)) for i, f in enumerate(feats)],
                                    "variable string, communality double").orderBy(F.col("communality").desc())
    ss = np.sum(m.loadings ** 2, axis=0)
    pct = ss / len(feats) * 100
    cum = np.cumsum(pct)
    var = spark.createDataFrame([(f"Factor {j + 1}", pround(ss[j], 4), pround(pct[j], 2), pround(cum[j], 2))
                                 for j in range(m.k)],
                                "factor string, ss_loadings double, pct_variance double, cumulative_pct double")
    return {"model": m, "loadings": load, "communalities": comm_df, "variance": var}
