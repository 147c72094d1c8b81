"""k-means fits that share their scans: every pass over the rows serves all
restarts and all numbers of clusters at once.

A pass sends standardised rows to numpy, a few thousand packed into one value that is
kept over the passes (or plain Arrow batches); distances to the centres are matrix
products, and what a task found is a few numbers a
centre, added up in Spark before the driver sees them. A fit depends on its own
seed alone, so its result does not change with the company it keeps (up to the
order of sums).

* Seeding: three rounds of weighted sampling without replacement (the smallest
  ``-log(u) / weight`` of all rows), first uniform, then by squared distance to the
  candidates so far; a pass counts the rows next to each candidate, and weighted
  k-means++ on the candidates chooses the centres.
* Many rows of few columns are first added up in the cells of a grid: iterations on
  the cells' means bring the starting centres near the places where they settle.
* Lloyd iterations over all rows until each fit's centres move less than ``tol`` together.
* Measures of any number of fits in two passes: squared-distance silhouette and
  Davies-Bouldin from per-cluster sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.linalg import add_up

#: Rows that a task compares with all centres at a time.
BLOCK = 8192
#: Cells of a grid, at most, and the bins a column must have in it.
CELLS, BINS = 1 << 16, 3
#: Rows from which centres are first moved on the cells.
GRID_ROWS = 1_000_000
#: Steps of a column that are counted for the grid's edges, and the share of the
#: tolerance at which fits on the cells stop.
STEPS, FINER = 512, 0.01


@dataclass
class Fit:
    k: int
    centers: np.ndarray
    cost: float           # squared distances of all rows to the nearest centre
    sizes: np.ndarray
    iterations: int


def _partitions(data: DataFrame) -> int:
    """Of a frame that many passes read: counted once."""
    if not hasattr(data, "_n_partitions"):
        data._n_partitions = data.rdd.getNumPartitions()
    return data._n_partitions


#: Name of a column of packed rows.
PACKED = "__rows"


def packed(data: DataFrame, d: int) -> DataFrame:
    """The first d columns (double, without NULLs) as blocks of up to BLOCK rows, in their order."""
    def run(batches):
        for b in batches:
            for _, x in _rows(b, d):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=[PACKED])

    return data.mapInArrow(run, f"{PACKED} binary")


def _rows(batch: pa.RecordBatch, d: int):
    """The first d columns of a batch as matrices of up to BLOCK rows."""
    if batch.schema.names[0] == PACKED:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1), np.frombuffer(batch.column(0)[i].as_buffer(), "<f8").reshape(-1, d)
        return
    for a in range(0, batch.num_rows, BLOCK):
        part = batch.slice(a, BLOCK)
        yield part, np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(d)], axis=1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = x @ (-2.0 * c.T)
    out += (c * c).sum(axis=1)
    out += (x * x).sum(axis=1)[:, None]
    return np.maximum(out, 0.0, out=out)


def _sums(data: DataFrame, d: int, width: int, n: int, found) -> np.ndarray:
    """Sum over all rows of ``found(batch, x)``, an (n, width) array a block."""
    def run(batches):
        total = np.zeros((n, width))
        for b in batches:
            for part, x in _rows(b, d):
                total += found(part, x)
        if total.any():
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["i", "s"])

    return add_up(data.mapInArrow(run, "i int, s array<double>"), n, width, _partitions(data))


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _closest(x: np.ndarray, c: np.ndarray, squares: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre (the first of equal ones) and squared distance."""
    dist = (-2.0 * c) @ x.T
    dist += (c * c).sum(axis=1)[:, None]
    best, lab = dist[0], np.zeros(len(x), np.int64)
    for j in range(1, len(c)):
        np.copyto(lab, j, where=dist[j] < best)
        np.minimum(best, dist[j], out=best)
    best += _squares(x) if squares is None else squares
    return lab, np.maximum(best, 0.0, out=best)


def _member(lab: np.ndarray, k: int) -> np.ndarray:
    """Labels x rows: 1 where the row has the label."""
    return (lab == np.arange(k)[:, None]).astype(float)


def _nearest(centers: list[np.ndarray]):
    """x -> per fit its rows' labels and squared distances."""
    ends = np.cumsum([len(x) for x in centers])

    def of(x: np.ndarray):
        squares = _squares(x)
        for c, end in zip(centers, ends):
            if len(c):
                yield end - len(c), *_closest(x, c, squares)
    return of


def _pass(data: DataFrame, d: int, centers: list[np.ndarray]) -> np.ndarray:
    """Per centre of all fits: rows, cost, sums of the columns."""
    n, ks = sum(map(len, centers)), [len(c) for c in centers if len(c)]
    near = _nearest(centers)

    def found(_, x):
        out = np.zeros((n, d + 2))
        for k, (first, lab, dist) in zip(ks, near(x)):
            mine = out[first:first + k]
            mine[:, 0], mine[:, 1] = np.bincount(lab, minlength=k), np.bincount(lab, dist, minlength=k)
            mine[:, 2:] = _member(lab, k) @ x
        return out
    return _sums(data, d, d + 2, n, found)


def lloyd(data: DataFrame, d: int, starts: list[np.ndarray], max_iter: int, tol: float) -> list[Fit]:
    """All fits from their starting centres, each until it settles."""
    now = [np.array(s, float) for s in starts]
    done, iterations = [max_iter == 0] * len(now), [0] * len(now)
    while not all(done):
        live = [j for j, x in enumerate(done) if not x]
        got, at = _pass(data, d, [now[j] for j in live]), 0
        for j in live:
            k = len(now[j])
            some = got[at:at + k]
            at += k
            moved = np.where(some[:, :1] > 0, some[:, 2:] / np.maximum(some[:, :1], 1), now[j])
            iterations[j] += 1
            done[j] = ((moved - now[j]) ** 2).sum() <= tol or iterations[j] >= max_iter
            now[j] = moved
    got, at, out = _pass(data, d, now), 0, []
    for j, c in enumerate(now):
        some = got[at:at + len(c)]
        at += len(c)
        out.append(Fit(len(c), c, float(some[:, 1].sum()), some[:, 0].astype(np.int64), iterations[j]))
    return out


def _sample(data: DataFrame, d: int, candidates: list[np.ndarray], sizes: list[int], seeds: list[int], step: int) -> list[np.ndarray]:
    """Per fit, rows drawn without replacement, weighted by squared distance to its
    candidates (equal weights where it has none)."""
    def run(batches):
        part = TaskContext.get().partitionId()
        rngs = [np.random.default_rng([s, step, part]) for s in seeds]
        best: list[tuple] = [(np.zeros(0), np.zeros((0, d)))] * len(sizes)
        for b in batches:
            for _, x in _rows(b, d):
                for j, c in enumerate(candidates):
                    u = rngs[j].exponential(size=len(x))
                    if len(c):
                        w = _closest(x, c)[1]
                        u = np.where(w > 1e-12, u / np.maximum(w, 1e-300), np.inf)
                    # only what is before the last kept row can be kept
                    ok = u < (best[j][0][-1] if len(best[j][0]) == sizes[j] else np.inf)
                    if not ok.any():
                        continue
                    keys, rows = np.concatenate([best[j][0], u[ok]]), np.concatenate([best[j][1], x[ok]])
                    few = np.argsort(keys, kind="stable")[:sizes[j]]
                    best[j] = keys[few], rows[few]
        for j, (keys, rows) in enumerate(best):
            ok = np.isfinite(keys)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), j, np.int32)), pa.array(keys[ok]),
                                                  pa.array(list(rows[ok]), pa.list_(pa.float64()))], names=["j", "key", "x"])

    top = Window.partitionBy("j").orderBy("key", "x")
    wanted = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("j") + 1)
    got = (data.mapInArrow(run, "j int, key double, x array<double>").withColumn("r", F.row_number().over(top))
           .where(F.col("r") <= max(sizes)).where(F.col("r") <= wanted).orderBy("j", "r").collect())
    out: list[list] = [[] for _ in sizes]
    for r in got:
        out[r["j"]].append(r["x"])
    return [np.array(o, float).reshape(-1, d) for o in out]


def _plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ and a few weighted Lloyd steps on the candidates."""
    if len(x) <= k:
        return x
    pick = [int(rng.choice(len(x), p=w / w.sum()))]
    near = ((x - x[pick[0]]) ** 2).sum(axis=1)
    while len(pick) < k:
        p = w * near
        if p.sum() <= 0:
            break
        pick.append(int(rng.choice(len(x), p=p / p.sum())))
        near = np.minimum(near, ((x - x[pick[-1]]) ** 2).sum(axis=1))
    c = x[pick].copy()
    for _ in range(30):
        lab = _distances(x, c).argmin(axis=1)
        n = np.bincount(lab, w, minlength=len(c))
        s = np.stack([np.bincount(lab, w * x[:, i], minlength=len(c)) for i in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1e-300)[:, None], c)
    return c


def seed_centers(data: DataFrame, d: int, ks: list[int], seeds: list[int], rounds: int = 3) -> list[np.ndarray]:
    """Starting centres of fits of ks[j] clusters with seeds[j]."""
    found = [np.zeros((0, d))] * len(ks)
    for step in range(rounds):
        more = _sample(data, d, found, [2 * k for k in ks], seeds, step)
        found = [np.concatenate([a, b]) for a, b in zip(found, more)]
    found = [np.unique(f, axis=0) for f in found]
    weights, at, out = _pass(data, d, found)[:, 0], 0, []
    for f, k, s in zip(found, ks, seeds):
        out.append(_plus_plus(f, np.maximum(weights[at:at + len(f)], 1e-9), k, np.random.default_rng([s, k])))
        at += len(f)
    return out


def _edges(data: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """Per column, edges of bins of about equal rows, from counts in fine steps of
    x / (1 + |x|), which has the same order and is between -1 and 1."""
    def found(_, x):
        at = ((x / (1 + np.abs(x)) + 1) * (STEPS / 2)).astype(np.int64).clip(0, STEPS - 1)
        return np.stack([np.bincount(c, minlength=STEPS) for c in at.T])

    share = _sums(data, d, STEPS, d, found).cumsum(axis=1)
    ends = (np.arange(1, STEPS) * 2 / STEPS) - 1
    ends = ends / (1 - np.abs(ends))
    wanted = np.arange(1, bins) / bins
    return [np.unique(ends[np.minimum(np.searchsorted(c, wanted * c[-1]), STEPS - 2)]) for c in share]


def _cells(data: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, rows) of the cells of a grid over all rows."""
    cuts = _edges(data, d, int(CELLS ** (1 / d) + 1e-9))
    sides = [len(c) + 1 for c in cuts]
    n = int(np.prod(sides))

    def run(batches):
        total = np.zeros((d + 1, n))
        for b in batches:
            for _, x in _rows(b, d):
                at = np.ravel_multi_index([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], sides)
                on, at, rows = np.unique(at, return_inverse=True, return_counts=True)
                total[0, on] += rows
                for i in range(d):
                    total[1 + i, on] += np.bincount(at, x[:, i], minlength=len(on))
        on = np.flatnonzero(total[0])
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), *[pa.array(t[on]) for t in total]], names=["i", "n", *names])

    names = [f"s{i}" for i in range(d)]
    got = (data.mapInArrow(run, "i int, n double, " + ", ".join(f"{c} double" for c in names)).groupBy("i")
           .agg(*[F.sum(c).alias(c) for c in ("n", *names)]).orderBy("i").toArrow())
    rows = got["n"].to_numpy()
    return np.stack([got[c].to_numpy() for c in names], axis=1) / rows[:, None], rows


def _near_start(data: DataFrame, d: int, starts: list[np.ndarray], max_iter: int, tol: float) -> list[np.ndarray]:
    """Starting centres moved by iterations on the cells' means, a task a fit."""
    means, rows = _cells(data, d)

    def run(batches):
        for b in batches:
            for j in b.column(0).to_pylist():
                c = np.array(starts[j], float)
                for _ in range(max_iter):
                    hot = _member(_closest(means, c)[0], len(c)) * rows
                    n = hot.sum(axis=1)[:, None]
                    moved = np.where(n > 0, hot @ means / np.maximum(n, 1), c)
                    done, c = ((moved - c) ** 2).sum() <= FINER * tol, moved
                    if done:
                        break
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int64()), pa.array([c.ravel()], pa.list_(pa.float64()))], names=["j", "c"])

    got = data.sparkSession.range(0, len(starts), 1, len(starts)).mapInArrow(run, "j long, c array<double>").collect()
    return [np.array(r["c"], float).reshape(-1, d) for r in sorted(got, key=lambda r: r["j"])]


def fit_all(data: DataFrame, d: int, ks: list[int], seeds: list[int], max_iter: int, tol: float, n: int = 0) -> list[Fit]:
    """Fits of ks[j] clusters with seeds[j]; ``n``: rows, if known to be many."""
    starts = seed_centers(data, d, ks, seeds)
    if CELLS >= BINS ** d and n >= GRID_ROWS:
        starts = _near_start(data, d, starts, max_iter, tol)
    return lloyd(data, d, starts, max_iter, tol)


def measures(data: DataFrame, d: int, centers: list[np.ndarray] | None = None, n_labels: int = 0) -> list[tuple[float, float, float]]:
    """Per fit (inertia around the members' means, silhouette, Davies-Bouldin).

    Rows belong to their nearest centre; without ``centers`` to the label in the
    column after the d features. Silhouette takes squared Euclidean distances, so
    a cluster's size, sum and sum of squares give a row's mean distance to it;
    Davies-Bouldin takes Euclidean distances to the members' means."""
    if centers is not None:
        ks, near = [len(c) for c in centers], _nearest(centers)

        def labels(_, x):
            return [lab for _, lab, _ in near(x)]
    else:
        ks = [n_labels]

        def labels(part, _):
            return [part.column(d).to_numpy(zero_copy_only=False).astype(np.int64)]
    firsts = np.cumsum([0, *ks])

    def hot(lab, k):
        out = np.zeros((len(lab), k))
        out[np.arange(len(lab)), lab] = 1.0
        return out

    def gather(part, x):
        sq = (x * x).sum(axis=1)
        return np.concatenate([np.concatenate([h.sum(axis=0)[:, None], (sq @ h)[:, None], h.T @ x], axis=1)
                               for lab, k in zip(labels(part, x), ks) for h in (hot(lab, k),)])
    sums = _sums(data, d, d + 2, int(firsts[-1]), gather)
    n, squares, y = sums[:, 0], sums[:, 1], sums[:, 2:]
    mean = y / np.maximum(n, 1)[:, None]

    def spread(part, x):
        out = []
        sq = (x * x).sum(axis=1)
        for lab, k, a in zip(labels(part, x), ks, firsts):
            nn, rows = n[a:a + k], np.arange(len(x))
            far = sq[:, None] + squares[a:a + k] / np.maximum(nn, 1) - 2 * (x @ mean[a:a + k].T)
            own = far[rows, lab] * nn[lab] / np.maximum(nn[lab] - 1, 1)
            far[rows, lab] = np.inf
            far[:, nn == 0] = np.inf
            other = far.min(axis=1)
            top = np.maximum(own, other)
            sil = np.where((nn[lab] > 1) & (top > 0) & np.isfinite(other), (other - own) / np.where(top > 0, top, 1), 0.0)
            off = ((x - mean[a:a + k][lab]) ** 2).sum(axis=1)
            out.append(np.stack([np.bincount(lab, v, minlength=k) for v in (sil, off, np.sqrt(off))], axis=1))
        return np.concatenate(out)
    got, out = _sums(data, d, 3, int(firsts[-1]), spread), []
    for k, a in zip(ks, firsts):
        on = np.flatnonzero(n[a:a + k]) + a
        s = got[on, 2] / n[on]
        gaps = np.sqrt(((mean[on][:, None] - mean[on]) ** 2).sum(axis=2))
        ratio = np.where(gaps > 0, (s[:, None] + s) / np.where(gaps > 0, gaps, 1), 0.0)
        np.fill_diagonal(ratio, 0.0)
        out.append((float(got[on, 1].sum()), float(got[on, 0].sum() / n[on].sum()) if len(on) else 0.0,
                    float(ratio.max(axis=1).mean()) if len(on) else 0.0))
    return out
