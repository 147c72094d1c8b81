"""Principal component analysis and scree eigenvalues.

Fit: one statistics pass + one Gramian pass on Spark, eigen-decomposition
of the d x d covariance on the driver.  Transform: each component is a
linear Column expression over the imputed / scaled features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, numeric_cols, pround
from tessera.functions.frames import multipass
from tessera.functions.linalg import Prepared, covariance, fix_signs, linear_columns, prepare


@dataclass
class PCAModel:
    prep: Prepared
    components: np.ndarray        # d x k
    explained_variance: np.ndarray
    ratio: np.ndarray
    all_eigen: np.ndarray

    @property
    def k(self) -> int:
        return self.components.shape[1]

    def transform(self, df: DataFrame, keep: list[str] | None = None, n: int | None = None,
                  prefix: str = "PC") -> DataFrame:
        """Scores PC1..PCn (+ ``keep`` columns)."""
        n = min(n or self.k, self.k)
        z = self.prep.columns(df)
        scores = linear_columns([F.col(f"__z{i}") for i in range(len(z))], self.components[:, :n],
                                [f"{prefix}{j + 1}" for j in range(n)])
        keep = keep or []
        return df.select(*[col(c) for c in keep], *z).select(*[col(c) for c in keep], *scores)

    def variance_table(self, digits: int = 2) -> list:
        cum = np.cumsum(self.ratio)
        return [(f"PC{j + 1}", pround(self.ratio[j] * 100, digits), pround(cum[j] * 100, digits),
                 pround(self.explained_variance[j], 4)) for j in range(self.k)]

    def n_components_for(self, share: float = 0.95) -> int | None:
        cum = np.cumsum(self.ratio)
        hit = np.nonzero(cum >= share)[0]
        return int(hit[0]) + 1 if len(hit) else None


def fit_pca(df: DataFrame, feats: list[str] | None = None, k: int = 5, scale: bool = True,
            target: str | None = None) -> PCAModel:
    """PCA on mean-imputed (and optionally standardised) features; the
    target is excluded from the default feature list.  Component signs:
    largest-magnitude loading positive."""
    feats = feats or [c for c in numeric_cols(df) if c != target]
    if len(feats) < 2:
        raise ValueError("PCA needs at least two features")
    with multipass(df, feats) as work:
        prep = prepare(work, feats, scale)
        n, _, cov = covariance(work, prep.columns(work), len(feats))
    k = min(k, n, len(feats))
    cov_s = cov * n / (n - 1) if n > 1 else cov
    vals, vecs = np.linalg.eigh(cov_s)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0, None), vecs[:, order]
    comps = fix_signs(vecs[:, :k])
    total = float(np.sum(vals)) or 1.0
    return PCAModel(prep, comps, vals[:k], vals[:k] / total, vals)


def pca_variance(df: DataFrame, feats=None, k: int = 5, scale: bool = True, target=None) -> DataFrame:
    """(component, explained_variance_pct, cumulative_pct, eigenvalue)."""
    m = fit_pca(df, feats, k, scale, target)
    return df.sparkSession.createDataFrame(
        m.variance_table(), "component string, explained_variance_pct double, cumulative_pct double, "
                            "eigenvalue double")


def pca_loadings(df: DataFrame, feats=None, k: int = 5, scale: bool = True, target=None) -> DataFrame:
    """(feature, PC1..PCk) rounded to 4."""
    m = fit_pca(df, feats, k, scale, target)
    rows = [[f] + [pround(m.components[i, j], 4) for j in range(m.k)] for i, f in enumerate(m.prep.feats)]
    schema = "feature string, " + ", ".join(f"PC{j + 1} double" for j in range(m.k))
    return df.sparkSession.createDataFrame(rows, schema)


def pca_scores(df: DataFrame, feats=None, k: int = 5, scale: bool = True, target=None,
               n_show: int = 10) -> DataFrame:
    """Scores of up to ``n_show`` components plus the target column."""
    m = fit_pca(df, feats, k, scale, target)
    return m.transform(df, [target] if target else [], min(n_show, m.k))


def scree(df: DataFrame, feats: list[str] | None = None, target: str | None = None) -> DataFrame:
    """Eigenvalues of the correlation matrix of the mean-imputed features,
    descending, positive only, with a Kaiser flag (eigenvalue > 1)."""
    feats = feats or [c for c in numeric_cols(df) if c != target]
    with multipass(df, feats) as work:
        prep = prepare(work, feats, True)
        n, _, cov = covariance(work, prep.columns(work), len(feats))
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1.0
    corr = cov / np.outer(sd, sd)
    vals = np.linalg.eigvalsh(corr)[::-1]
    vals = vals[vals > 0]
    rows = [(f"F{i + 1}", pround(v, 4), bool(v > 1)) for i, v in enumerate(vals)]
    return df.sparkSession.createDataFrame(rows, "factor string, eigenvalue double, kaiser boolean")
