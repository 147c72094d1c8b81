"""Principal components of thousands of columns (D1, D6) without a square of all columns.

Block Lanczos: a pass over the rows multiplies the covariance with a block of a few
directions, the new block is made orthogonal to those before, and the components are read
off the small matrix of the covariance in all blocks so far, until what is left of
``C v - lambda v`` is within the tolerance for every component.  The driver holds columns x
(block x passes) numbers, a task columns x block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col
from tessera.functions.frames import multipass
from tessera.functions.linalg import FAN, fix_signs

#: Directions of a block beyond the components wanted.
EXTRA = 10
#: Left-over of an eigenvector, as a share of the largest eigenvalue, at which passes end.
TOLERANCE = 1e-9
#: Passes after which a fit ends in any case, and tells so.
PASSES = 60
#: Columns whose sums are one row of a task's result.
STRIPE = 512


@dataclass
class WidePCA:
    feats: list[str] | str
    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray          # columns x k
    explained_variance: np.ndarray
    ratio: np.ndarray
    n: int
    passes: int
    left: float                     # largest left-over, as a share of the largest eigenvalue

    @property
    def k(self) -> int:
        return self.components.shape[1]

    @property
    def converged(self) -> bool:
        return self.left <= TOLERANCE

    def transform(self, df: DataFrame, keep: list[str] | None = None, n: int | None = None, prefix: str = "PC") -> DataFrame:
        """Scores PC1..PCn (+ ``keep`` columns), a matrix product per Arrow batch."""
        n, keep = min(n or self.k, self.k), keep or []
        weights = self.components[:, :n] / self.scale[:, None]
        names, offset = [f"{prefix}{j + 1}" for j in range(n)], self.mean

        def run(batches):
            for b in batches:
                if b.num_rows:
                    x = _rows(b.columns[len(keep):], len(offset))
                    scores = np.where(np.isnan(x), 0.0, x - offset) @ weights
                    yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *[pa.array(s) for s in scores.T]], names=[*keep, *names])

        return df.select(*[col(c) for c in keep], *_columns(df, self.feats)).mapInArrow(
            run, T.StructType([*[df.schema[c] for c in keep], *[T.StructField(m, T.DoubleType()) for m in names]]))


def _columns(df: DataFrame, feats: list[str] | str):
    if isinstance(feats, str):
        return [col(feats).cast("array<double>").alias("__x")]
    return [col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(feats)]


def _rows(columns: list[pa.Array], d: int) -> np.ndarray:
    """Rows x columns, missing values as NaN; a missing array is a row of missing values."""
    if not pa.types.is_list(columns[0].type):
        return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
    arrays = columns[0]
    there = arrays.is_valid().to_numpy(zero_copy_only=False)
    lengths = arrays.value_lengths().drop_null().to_numpy()
    if (lengths != d).any():
        raise ValueError(f"arrays of other lengths than {d}")
    out = np.full((len(arrays), d), np.nan)
    out[there] = arrays.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    return out


def _sums(df: DataFrame, width: int, d: int, of) -> np.ndarray:
    """Sum over all batches of ``of(rows)``, d x width; tasks' sums are merged in Spark, some
    ``FAN`` at a time, in stripes of columns."""
    def run(batches):
        total, seen = np.zeros((d, width)), False
        for b in batches:
            if b.num_rows:
                total, seen = total + of(_rows(b.columns, d)), True
        if seen:
            at = range(0, d, STRIPE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at), dtype=np.int32)), pa.array(np.full(len(at), TaskContext.get().partitionId() % FAN, np.int32)),
                                              pa.array([total[a:a + STRIPE].ravel() for a in at], pa.list_(pa.float64()))], names=["i", "g", "s"])

    def merge(t: pa.Table) -> pa.Table:
        s = np.array(t["s"].combine_chunks().flatten()).reshape(t.num_rows, -1).sum(axis=0)
        return pa.Table.from_arrays([t["i"].slice(0, 1), t["g"].slice(0, 1), pa.array([s], pa.list_(pa.float64()))], names=["i", "g", "s"])

    kind = "i int, g int, s array<double>"
    out = np.zeros((d, width))
    merged = df.mapInArrow(run, kind).groupBy("i", "g").applyInArrow(merge, kind).groupBy("i").applyInArrow(merge, kind)
    for r in merged.toArrow().to_pylist():
        out[r["i"] * STRIPE:(r["i"] + 1) * STRIPE] = np.array(r["s"]).reshape(-1, width)
    return out


def fit_wide_pca(df: DataFrame, feats: list[str] | str, k: int = 10, scale: bool = True, extra: int = EXTRA,
                 tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 42) -> WidePCA:
    """The first ``k`` components of the columns ``feats`` (or the elements of an array column
    of one length), mean-imputed and, if wanted, divided by their standard deviations
    (constant columns are left as they are). Signs: largest-magnitude loading positive.
    No rows: ValueError. A fit that ends after ``passes`` passes tells its left-over."""
    with multipass(df.select(*_columns(df, feats))) as work:
        d = len(feats)
        if isinstance(feats, str):
            d = work.agg(F.max(F.size("__x"))).first()[0]
        if not d or d < 0:
            raise ValueError("no columns to take components of")
        one = _sums(work, 3, d, lambda x: np.column_stack([np.isfinite(x).sum(axis=0), np.nansum(x, axis=0), np.full(d, len(x))]))
        n = int(one[0, 2])
        if not n:
            raise ValueError("no rows to take components of")
        mean = one[:, 1] / np.maximum(one[:, 0], 1)
        spread = _sums(work, 1, d, lambda x: np.nansum((x - mean) ** 2, axis=0)[:, None])[:, 0]
        sd = np.sqrt(spread / n)
        flat = sd <= 1e-7 * np.maximum(1.0, np.abs(mean))
        sd[flat] = 1.0
        unit = sd if scale else np.ones(d)
        total = float((np.where(flat, 0.0, spread) / unit ** 2).sum()) / max(n - 1, 1)
        k, size = min(k, d, n), min(d, k + extra)

        def times(block: np.ndarray) -> np.ndarray:
            """Covariance times a block of directions."""
            def of(x):
                z = np.where(np.isnan(x) | flat, 0.0, (x - mean) / unit)
                return z.T @ (z @ block)
            return _sums(work, block.shape[1], d, of) / max(n - 1, 1)

        block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, size)))[0]
        basis, image, done = np.zeros((d, 0)), np.zeros((d, 0)), 0
        while True:
            new = times(block)
            basis, image, done = np.hstack([basis, block]), np.hstack([image, new]), done + 1
            inner = basis.T @ image
            vals, vecs = np.linalg.eigh((inner + inner.T) / 2)
            vals, vecs = vals[::-1][:k], vecs[:, ::-1][:, :k]
            found = basis @ vecs
            left = np.abs(image @ vecs - found * vals).max(initial=0.0) / max(vals[0], 1e-300) if vals[0] > 0 else 0.0
            room = d - basis.shape[1]
            if left <= tolerance or not room or done >= passes:
                break
            for _ in range(2):  # the second time takes what rounding left
                new = new - basis @ (basis.T @ new)
            u, s, _ = np.linalg.svd(new, full_matrices=False)
            u = u[:, s > 1e-12 * max(vals[0], 1e-300)][:, :room]
            if not u.shape[1]:
                break
            u = u - basis @ (basis.T @ u)
            block = np.linalg.qr(u)[0]
    vals = np.clip(vals, 0.0, None)
    return WidePCA(feats, mean, unit, fix_signs(found), vals, vals / (total or 1.0), n, done, float(left))
