"""k-means clustering and its diagnostics.

Features are mean-imputed and standardised. Restarts, and in the K scan all
numbers of clusters, are fitted and measured by scans they share
(``shared_kmeans``); of the restarts the one of least cost is kept."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, num, numeric_cols, pround, rnd
from tessera.functions.frames import multipass
from tessera.functions.linalg import Prepared, prepare
from tessera.operators import shared_kmeans as SK
from tessera.operators.reduce import fit_pca

#: Fits stop when their centres' squared moves add up to this share of a variance.
TOLERANCE = 1e-4


@dataclass
class KMeansResult:
    prep: Prepared
    k: int
    centers: np.ndarray       # k x d, in standardised space, largest cluster first
    cost: float
    sizes: np.ndarray

    def assign(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Nearest centre (the first of equal ones) as ``cluster`` (0-based) plus
        ``KMeans_Cluster`` = "Cluster n" (1-based); the standardised features
        ``__z*`` are kept for diagnostics."""
        keep = keep if keep is not None else df.columns
        centers = self.centers

        @F.pandas_udf("int")
        def nearest(*x: pd.Series) -> pd.Series:
            return pd.Series(SK._closest(np.stack([c.to_numpy() for c in x], axis=1), centers)[0].astype(np.int32))

        # else Spark moves filters on the cluster below the columns' projections, and the filter's
        # constraints double with each column that has a name there: the driver's heap runs full
        nearest = nearest.asNondeterministic()
        z = self.prep.columns(df)
        out = df.select(*[col(c) for c in keep], *z)
        out = out.withColumn("cluster", nearest(*[F.col(f"__z{i}") for i in range(len(z))]))
        return out.withColumn("KMeans_Cluster", F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string")))


@contextmanager
def _standardised(df: DataFrame, feats: list[str]):
    """(prep, data): the features every pass reads, kept over the passes and
    spread where the input has fewer partitions than there are cores."""
    if len(feats) < 2:
        raise ValueError("clustering needs at least two features")
    prep = prepare(df, feats, True)
    data = df.select(*prep.columns(df))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if data.rdd.getNumPartitions() < cores:
        data = data.repartition(cores)
    data = SK.packed(data, len(feats)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield prep, data
    finally:
        data.unpersist()


def _result(prep: Prepared, fit: SK.Fit) -> KMeansResult:
    order = sorted(range(len(fit.centers)), key=lambda j: (-fit.sizes[j], tuple(fit.centers[j])))
    return KMeansResult(prep, len(order), fit.centers[order], fit.cost, fit.sizes[order])


def fit_kmeans(df: DataFrame, feats: list[str] | None = None, k: int = 4, n_init: int = 10,
               max_iter: int = 300, seed: int = 42, init: np.ndarray | None = None) -> KMeansResult:
    """Best of ``n_init`` fits, the first of equal costs; default features are all
    numeric columns (a target column is not excluded). ``init`` gives the starting
    centres (standardised) of a single fit. Clusters are numbered by size (largest
    first), then by centre."""
    feats = feats or numeric_cols(df)
    with _standardised(df, feats) as (prep, data):
        if init is not None:
            fits = SK.lloyd(data, len(feats), [init], max_iter, TOLERANCE)
        else:
            fits = SK.fit_all(data, len(feats), [k] * n_init, [seed + r for r in range(n_init)], max_iter, TOLERANCE, prep.n)
    return _result(prep, min(fits, key=lambda f: f.cost))


_METRICS = "k int, inertia double, silhouette double, davies_bouldin double"


def cluster_metrics(assigned: DataFrame, res: KMeansResult, digits: int | None = 4) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin) of rows with ``__z*`` and
    ``cluster``. Silhouette takes squared Euclidean distances (linear time);
    Davies-Bouldin Euclidean distances to each cluster's mean."""
    d = len(res.prep.feats)
    with multipass(assigned.select(*[f"__z{i}" for i in range(d)], F.col("cluster").cast("double"))) as rows:
        (found,) = SK.measures(rows, d, n_labels=res.k)
    return assigned.sparkSession.createDataFrame([(res.k, *(v if digits is None else pround(v, digits) for v in found))], _METRICS)


def kmeans_scan(df: DataFrame, feats: list[str] | None = None, ks: list[int] | None = None,
                n_init: int = 3, max_iter: int = 100, seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin, best) for K in
    2 .. min(12, n // 5 + 2) - 1: every K is fitted on all rows and measured on
    all rows; best is the highest unrounded silhouette, the first on ties."""
    feats = feats or numeric_cols(df)
    with _standardised(df, feats) as (prep, data):
        ks = ks if ks is not None else list(range(2, min(12, prep.n // 5 + 2)))
        fits = SK.fit_all(data, len(feats), [k for k in ks for _ in range(n_init)], [seed + r for _ in ks for r in range(n_init)],
                          max_iter, TOLERANCE, prep.n) if ks else []
        best_of = [min(fits[i * n_init:(i + 1) * n_init], key=lambda f: f.cost) for i in range(len(ks))]
        rows = SK.measures(data, len(feats), [f.centers for f in best_of]) if ks else []
    best = max(range(len(rows)), key=lambda i: (rows[i][1], -i)) if rows else None
    out = [(k, *(pround(v, 4) for v in r), i == best) for i, (k, r) in enumerate(zip(ks, rows))]
    return df.sparkSession.createDataFrame(out, _METRICS + ", best boolean")


def cluster_profile(assigned: DataFrame, feats: list[str], digits: int = 3) -> DataFrame:
    """Mean of each original (unimputed) feature per cluster label."""
    return (assigned.groupBy("KMeans_Cluster")
            .agg(*[rnd(F.avg(num(assigned, c)), digits).alias(c) for c in feats]).orderBy("KMeans_Cluster"))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """(KMeans_Cluster, count), largest first."""
    return assigned.groupBy("KMeans_Cluster").count().orderBy(F.col("count").desc(), "KMeans_Cluster")


def cluster_projection(assigned: DataFrame, res: KMeansResult) -> DataFrame:
    """PCA (up to 3 components) of the standardised features + cluster."""
    d = len(res.prep.feats)
    zc = [f"__z{i}" for i in range(d)]
    pca = fit_pca(assigned.select(*zc), zc, min(3, d), scale=False)
    return pca.transform(assigned.select(*zc, "KMeans_Cluster"), ["KMeans_Cluster"])
