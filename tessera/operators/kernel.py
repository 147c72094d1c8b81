"""Features of an RBF kernel with a measured error (M6).

Rows are mapped to their projections on a few landmark rows (Nystrom): the product of
two rows' features is their kernel, and what a row's own kernel lacks, its residual,
bounds every error, |k(x, y) - f(x).f(y)| <= sqrt(r(x) r(y)).  A pass over the rows
measures all residuals and draws rows in proportion to them; they become further
landmarks until the mean residual is within the bound.  Landmarks depend on the shape
of the data and the bound, not on the number of rows."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col
from tessera.functions.frames import multipass
from tessera.functions.linalg import add_up, prepare

#: Mean residual at which no more landmarks are added.
BOUND = 0.01
#: Landmarks of the first round; each later round doubles them.
FIRST = 64
#: Landmarks at most: a task holds their square. A fit that ends here says that its bound does not hold.
MOST = 2048
#: Rows drawn a round, in units of the landmarks wanted (the residuals are those of the round before).
DRAWN = 4
#: Features that a task holds at a time.
BLOCK = 4_000_000
#: Directions of the landmarks' kernel that are left out, as a share of the largest.
FLAT = 1e-12


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    far = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(far, 0.0))


@dataclass
class KernelMap:
    landmarks: np.ndarray
    root: np.ndarray            # kernels with the landmarks @ root = features
    gamma: float
    bound: float
    mean_residual: float = 1.0
    max_residual: float = 1.0

    @classmethod
    def of(cls, landmarks: np.ndarray, gamma: float, bound: float) -> KernelMap:
        vals, vecs = np.linalg.eigh(rbf(landmarks, landmarks, gamma))
        kept = vals > FLAT * max(vals.max(initial=0.0), 1.0)
        return cls(landmarks, vecs[:, kept] / np.sqrt(vals[kept]), gamma, bound)

    @property
    def holds(self) -> bool:
        """Is the mean residual over the fitted rows within the bound?"""
        return self.mean_residual <= self.bound

    def features(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.landmarks, self.gamma) @ self.root

    def blocks(self, x: np.ndarray) -> list[np.ndarray]:
        """The rows in parts whose features a task can hold; at least one."""
        step = max(1, BLOCK // max(1, len(self.landmarks)))
        return [x[a:a + step] for a in range(0, max(1, len(x)), step)]

    def residuals(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip(1.0 - (self.features(part) ** 2).sum(axis=1), 0.0, 1.0) for part in self.blocks(x)])

    def transform(self, df: DataFrame, cols: list[str], name: str = "features") -> DataFrame:
        """Adds the features (array of double), a matrix product per Arrow batch."""
        places = [df.columns.index(c) for c in cols]

        def run(batches):
            for b in batches:
                x, a = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in places], axis=1), 0
                for part in self.blocks(x) if b.num_rows else []:
                    got = self.features(part)
                    ends = np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]
                    yield pa.RecordBatch.from_arrays([*b.slice(a, len(got)).columns, pa.ListArray.from_arrays(ends, got.ravel())],
                                                     names=[*b.schema.names, name])
                    a += len(got)

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def scale_gamma(df: DataFrame, cols: list[str]) -> tuple[int, float]:
    """Rows, and 1 / (columns x variance of all entries)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.var_pop(col(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    if not r["n"]:
        raise ValueError("no rows to fit a kernel on")
    spread = np.mean([r[f"v{i}"] for i in range(len(cols))]) + np.var([r[f"m{i}"] for i in range(len(cols))])
    return r["n"], 1.0 / (len(cols) * spread) if spread > 0 else 1.0


def _measured(df: DataFrame, cols: list[str], found: KernelMap, weight: float, seed: int):
    """(sum and greatest of the residuals, drawn rows): a row is drawn with
    probability ``weight`` times its residual, the same way if its task runs again."""
    def run(batches):
        total, top, drawn, seen = 0.0, 0.0, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            r = found.residuals(x)
            total, top, seen = total + r.sum(), max(top, r.max()), seen + len(x)
            luck = np.random.default_rng([seed, zlib.crc32(x.tobytes()), seen]).random(len(x))
            drawn.append(np.unique(x[luck < weight * r], axis=0))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([top]), pa.array(
                [[list(r) for d in drawn for r in d]], pa.list_(pa.list_(pa.float64())))], names=["s", "top", "drawn"])

    row = (df.select(*[col(c).cast("double") for c in cols]).mapInArrow(run, "s double, top double, drawn array<array<double>>")
           .agg(F.sum("s").alias("s"), F.max("top").alias("top"), F.flatten(F.collect_list("drawn")).alias("drawn")).first())
    drawn = np.array(row["drawn"], dtype=float).reshape(-1, len(cols))
    return row["s"], row["top"], np.unique(drawn, axis=0)


def fit_kernel(df: DataFrame, cols: list[str], gamma: float | str = "scale", bound: float = BOUND,
               first: int = FIRST, most: int = MOST, seed: int = 42) -> KernelMap:
    """Landmarks for the rows of ``df`` (columns without missing values; persisted by
    the caller). ``gamma``: a number, or "scale" for 1 / (columns x variance).
    Repeated rows are drawn by their number, and are one landmark. No rows: ValueError."""
    n, scaled = scale_gamma(df, cols)
    gamma = scaled if gamma == "scale" else float(gamma)
    found = KernelMap(np.zeros((0, len(cols))), np.zeros((0, 0)), gamma, bound)
    before, want, more, turn = float(n), first, DRAWN, 0
    while True:
        total, top, drawn = _measured(df, cols, found, more * want / before, seed + turn)
        found.mean_residual, found.max_residual = total / n, top
        room = most - len(found.landmarks)
        if found.holds or room <= 0:
            return found
        before, turn = total, turn + 1
        if not len(drawn):
            more *= 2
            continue
        chosen = np.random.default_rng([seed, turn]).permutation(len(drawn))[:min(want, room)]
        marks = np.unique(np.concatenate([found.landmarks, drawn[np.sort(chosen)]]), axis=0)
        if len(marks) == len(found.landmarks):  # what is left is rounding
            return found
        found = KernelMap.of(marks, gamma, bound)
        want = len(marks)


def kernel_means(df: DataFrame, feats: list[str], by: str, gamma: float | str = "scale", bound: float = 1e-6) -> DataFrame:
    """(a, b, mean_kernel): the mean kernel of all pairs of a row of group a and a row of
    group b (a <= b, NULL groups left out), on mean-imputed, standardised features, without
    forming pairs: the product of the groups' mean features. Each mean is off by at most the
    root of the product of the groups' mean residuals. The distance of two groups'
    distributions (maximum mean discrepancy) is aa + bb - 2 ab."""
    with multipass(df, list(dict.fromkeys([*feats, by]))) as work:
        prep = prepare(work, feats, True)
        cols = [f"__z{i}" for i in range(len(feats))]
        rows = work.select(col(by).cast("string").alias("g"), *prep.columns(work)).where(F.col("g").isNotNull())
        groups = [r["g"] for r in rows.select("g").distinct().orderBy("g").collect()]
        kind = "a string, b string, mean_kernel double"
        if not groups:
            return df.sparkSession.createDataFrame([], kind)
        found = fit_kernel(rows, cols, gamma, bound)
        at, width = {g: i for i, g in enumerate(groups)}, found.root.shape[1]

        def run(batches):
            total = np.zeros((len(at), width + 1))
            for b in batches:
                if b.num_rows:
                    f = found.features(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1))
                    np.add.at(total, [at[g] for g in b.column(0).to_pylist()], np.column_stack([f, np.ones(len(f))]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
                                             names=["i", "s"])

        sums = add_up(rows.mapInArrow(run, "i int, s array<double>"), len(at), width + 1, rows.rdd.getNumPartitions())
    mean = sums[:, :-1] / sums[:, -1:]
    both = mean @ mean.T
    return df.sparkSession.createDataFrame([(a, b, float(both[i, j])) for i, a in enumerate(groups) for j, b in enumerate(groups) if i <= j], kind)
