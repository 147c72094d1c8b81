"""Feature-matrix moments on Spark, small d x d algebra on the driver.

Only d-length vectors and d x d matrices (d = number of features) reach
the driver; the row-sized work is one statistics pass and one pass of sums
of products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import num


@dataclass
class Prepared:
    """Mean imputation (+ optional standard scaling) fitted on a frame."""
    feats: list[str]
    n: int
    mean: np.ndarray      # raw means (imputation values)
    shift: np.ndarray     # subtracted after imputation
    scale: np.ndarray     # divided after centring (1 where not scaling)

    def columns(self, df: DataFrame, prefix: str = "__z") -> list[Column]:
        """Processed features as Columns ``__z0..``: (coalesce(x, mean) - shift) / scale."""
        out = []
        for i, c in enumerate(self.feats):
            x = F.coalesce(num(df, c), F.lit(float(self.mean[i]) if np.isfinite(self.mean[i]) else 0.0))
            out.append(((x - F.lit(float(self.shift[i]))) / F.lit(float(self.scale[i]))).alias(f"{prefix}{i}"))
        return out


def prepare(df: DataFrame, feats: list[str], scale: bool = True) -> Prepared:
    """Fit mean imputation and population-std scaling in one pass.  The
    imputed column keeps its mean; its variance is the raw sum of squared
    deviations over all n rows."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(feats):
        x = num(df, c)
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    r = df.agg(*aggs).collect()[0]
    n = r["n"]
    mean = np.array([r[f"m{i}"] if r[f"m{i}"] is not None else 0.0 for i in range(len(feats))], float)
    var_imp = np.array([(r[f"v{i}"] or 0.0) * r[f"c{i}"] / n if n else 0.0 for i in range(len(feats))], float)
    sd = np.sqrt(var_imp)
    sd[sd == 0] = 1.0
    return Prepared(feats, n, mean, mean.copy(), sd if scale else np.ones(len(feats)))


#: Up to so many columns the sums of products are one aggregate in the JVM;
#: beyond, a task forms them for its Arrow batches by a matrix product.
WIDE = 12


def covariance(df: DataFrame, cols: list[Column], n_cols: int):
    """(n, column means, population covariance) of ``n_cols`` numeric Columns
    without NULLs, from one pass of sums of products. Columns should be about
    centred (as ``prepare`` makes them), so that nothing cancels."""
    z = df.select(*[c.alias(f"__g{i}") for i, c in enumerate(cols)])
    names = z.columns
    pairs = [(i, j) for i in range(n_cols) for j in range(i, n_cols)]
    if n_cols <= WIDE:
        row = z.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)],
                    *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
        n = row["n"]
        sums = [row[f"s{i}"] or 0.0 for i in range(n_cols)]
        products = {(i, j): row[f"p{i}_{j}"] or 0.0 for i, j in pairs}
    else:
        rows = (z.select(*[F.col(c).cast("double") for c in names]).mapInArrow(_products(n_cols), "i int, j int, s double")
                .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
        products = {(r["i"], r["j"]): r["s"] for r in rows}
        n = int(products.get((n_cols, n_cols), 0))
        sums = [products.get((i, n_cols), 0.0) for i in range(n_cols)]
    mean = np.array(sums) / max(n, 1)
    cov = np.zeros((n_cols, n_cols))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = products.get((i, j), 0.0) / max(n, 1) - mean[i] * mean[j]
    flat = np.diag(cov) <= 1e-14 * np.maximum(1.0, mean ** 2)
    cov[flat], cov[:, flat] = 0.0, 0.0
    return n, mean, cov


def _products(d: int):
    """Per task: sums of products of all pairs of columns and a column of ones."""
    def run(batches):
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            x = np.stack([*[c.to_numpy(zero_copy_only=False) for c in b.columns], np.ones(b.num_rows)], axis=1)
            total += x.T @ x
        i, j = np.triu_indices(d + 1)
        if total[d, d]:
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                                             names=["i", "j", "s"])
    return run


#: Columns of a block of masked products: a task holds four squares of this width.
MASKED_WIDTH = 1024
#: Tasks whose products are merged at a time.
FAN = 64


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x columns, missing values (NULL or NaN) as NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)


def column_facts(df: DataFrame, cols: list[Column]) -> dict[str, np.ndarray]:
    """Per column: values present, mean, least and greatest, and the number of rows,
    from one pass of Arrow batches (any number of columns)."""
    d = len(cols)

    def run(batches):
        n, rows = np.zeros(d, np.int64), 0
        total, low, high = np.zeros(d), np.full(d, np.inf), np.full(d, -np.inf)
        for b in batches:
            x = _matrix(b)
            there = ~np.isnan(x)
            rows += len(x)
            n += there.sum(axis=0)
            total += np.where(there, x, 0.0).sum(axis=0)
            low = np.minimum(low, np.where(there, x, np.inf).min(axis=0, initial=np.inf))
            high = np.maximum(high, np.where(there, x, -np.inf).max(axis=0, initial=-np.inf))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, rows)), pa.array(n), pa.array(total),
                                              pa.array(low), pa.array(high)], names=["i", "rows", "n", "s", "lo", "hi"])

    got = (df.select(*[c.cast("double").alias(f"__g{i}") for i, c in enumerate(cols)]).mapInArrow(
        run, "i int, rows long, n long, s double, lo double, hi double").groupBy("i")
        .agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .orderBy("i").collect())
    if not got:
        return {"rows": np.zeros(d, int), "n": np.zeros(d, int), "mean": np.zeros(d), "lo": np.full(d, np.inf), "hi": np.full(d, -np.inf)}
    n = np.array([r["n"] for r in got])
    return {"rows": np.array([r["rows"] for r in got]), "n": n, "mean": np.array([r["s"] for r in got]) / np.maximum(n, 1),
            "lo": np.array([r["lo"] for r in got]), "hi": np.array([r["hi"] for r in got])}


def masked_products(df: DataFrame, cols: list[Column], shift: np.ndarray):
    """(n, s, q, p), d x d each: over the rows where columns i and j are both
    present, their number, the sum of i, of i squared and of i times j, all of values
    less ``shift``. A job serves two blocks of columns; up to MASKED_WIDTH columns
    that is one job."""
    d = len(cols)
    out = np.zeros((4, d, d))
    blocks = [(a, min(a + MASKED_WIDTH, d)) for a in range(0, d, MASKED_WIDTH)]
    for x, (a, b) in enumerate(blocks):
        for e, f in blocks[x:]:
            out[:, a:b, e:f] = _block_products(df, cols[a:b], cols[e:f], shift[a:b], shift[e:f], a == e)
            if e > a:  # s and q are not symmetric
                out[:, e:f, a:b] = _block_products(df, cols[e:f], cols[a:b], shift[e:f], shift[a:b], False)
    return out


def _block_products(df: DataFrame, left: list[Column], right: list[Column], ls: np.ndarray, rs: np.ndarray, same: bool) -> np.ndarray:
    w, v = len(left), len(right)
    cols = left if same else left + right

    def run(batches):
        total = np.zeros((4, w, v))
        for b in batches:
            m = _matrix(b)
            x, y = m[:, :w] - ls, (m if same else m[:, w:]) - rs
            here, there = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            total += np.stack([here.T @ there, x.T @ there, (x * x).T @ there, x.T @ y])
        if total[0].any():
            flat = total.transpose(1, 0, 2).reshape(w, 4 * v)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(w, dtype=np.int32)), pa.array(np.full(w, TaskContext.get().partitionId() % FAN, np.int32)),
                                              pa.array(list(flat), pa.list_(pa.float64()))], names=["i", "g", "s"])

    def merge(t: pa.Table) -> pa.Table:
        s = np.array(t["s"].combine_chunks().flatten()).reshape(t.num_rows, -1).sum(axis=0)
        return pa.Table.from_arrays([t["i"].slice(0, 1), t["g"].slice(0, 1), pa.array([s], pa.list_(pa.float64()))], names=["i", "g", "s"])

    kind = "i int, g int, s array<double>"
    parts = df.select(*[c.cast("double").alias(f"__g{i}") for i, c in enumerate(cols)]).mapInArrow(run, kind)
    out = np.zeros((w, 4, v))
    for r in parts.groupBy("i", "g").applyInArrow(merge, kind).groupBy("i").applyInArrow(merge, kind).toArrow().to_pylist():
        out[r["i"]] = np.array(r["s"]).reshape(4, v)
    return out.transpose(1, 0, 2)


#: Numbers from all tasks that may go to the driver unmerged.
DIRECT = 4_000_000


def add_up(rows: DataFrame, n: int, width: int, tasks: int) -> np.ndarray:
    """Sums by ``i`` of the tasks' rows (i, s: array of ``width`` numbers) as an
    (n, width) array; merged in Spark first if there are many."""
    if tasks * n * width > DIRECT:
        rows = (rows.select("i", F.posexplode("s").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
                .groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("s")))
    total, t = np.zeros((n, width)), rows.toArrow()
    if t.num_rows:
        values = np.array(t["s"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
        np.add.at(total, t["i"].to_numpy(), values)
    return total


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Make the largest-magnitude entry of each column positive."""
    v = vectors.copy()
    for j in range(v.shape[1]):
        i = int(np.argmax(np.abs(v[:, j])))
        if v[i, j] < 0:
            v[:, j] = -v[:, j]
    return v


#: Products of one projection that are left to generated code.
MANY_TERMS = 128


def linear_columns(zcols: list[Column], weights: np.ndarray, names: list[str],
                   offset: np.ndarray | None = None) -> list[Column]:
    """``names[j] = sum_i z_i * W[i, j] (+ offset[j])``: built-in Column arithmetic,
    or, with more than ``MANY_TERMS`` products (whose generated code would be too
    long to compile), elements of one matrix product per Arrow batch."""
    if weights.size > MANY_TERMS:
        add = np.zeros(weights.shape[1]) if offset is None else offset

        @F.pandas_udf("array<double>")
        def product(x: pd.Series) -> pd.Series:
            m = np.array(x.tolist(), dtype=float)  # a missing value makes its row's scores missing
            return pd.Series([None if np.isnan(r).any() else r for r in m @ weights + add])

        scores = product(F.array(*[z.cast("double") for z in zcols]))
        return [F.get(scores, F.lit(j)).alias(nm) for j, nm in enumerate(names)]
    out = []
    for j, nm in enumerate(names):
        terms = [z * F.lit(float(weights[i, j])) for i, z in enumerate(zcols) if weights[i, j] != 0.0]
        e = terms[0] if terms else F.lit(0.0)
        for t in terms[1:]:
            e = e + t
        if offset is not None:
            e = e + F.lit(float(offset[j]))
        out.append(e.alias(nm))
    return out


# Orthogonal rotation by repeated singular value decompositions (Kaiser 1958;
# the usual orthomax iteration, as in scikit-learn, BSD 3-clause licence).
def varimax_like(loadings: np.ndarray, gamma: float, tol: float = 1e-6, max_iter: int = 100) -> np.ndarray:
    """Orthogonal rotation of a (p x k) loading matrix maximising the
    orthomax criterion (gamma = 1: varimax, 0: quartimax), by the
    standard SVD iteration (Kaiser 1958)."""
    p, k = loadings.shape
    rot = np.eye(k)
    crit = 0.0
    for _ in range(max_iter):
        lam = loadings @ rot
        target = lam ** 3 - (gamma / p) * lam @ np.diag(np.sum(lam ** 2, axis=0))
        u, s, vt = np.linalg.svd(loadings.T @ target)
        rot = u @ vt
        new = float(np.sum(s))
        if crit != 0 and new < crit * (1 + tol):
            break
        crit = new
    return loadings @ rot
