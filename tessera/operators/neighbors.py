"""k-nearest-neighbour classification (M8), fitted on all train rows.

Equal vectors of one label become one fitted row with a count of at most k, and a
vector is voted on once, whatever the number of its rows. Up to ``FEW`` fitted rows
go to the tasks as one matrix, sorted into boxes of near rows; the query rows
of a box are compared with the boxes that can hold a neighbour of theirs, in blocks
by a matrix product, so a task holds the matrix and one block of distances.

More of them are dealt to the leaves of a tree of cuts across single columns. Each leaf
finds its own vectors' neighbours among its fitted rows; a vector that may have a nearer
one elsewhere (the ball that holds k fitted rows reaches another leaf's fitted rows) asks
those leaves too, and the answers are merged. Votes return to the rows by a join.

The product only picks candidates: distances that decide are summed from differences.
Ties on distance are broken by label (smallest first); the vote picks the most frequent
label, the smallest on ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.frames import stored

#: Fitted rows that go to all tasks as one matrix, at most.
FEW = 100_000
#: Vectors of a leaf beyond that, about; rows that decide where its cuts lie; vectors that ask a leaf at a time.
LEAF, MARKS, ASKED = 50_000, 64, 100_000
#: Distances that a task holds at a time.
BLOCK = 4_000_000
#: Fitted rows of a box, and query rows that are dealt to the boxes at a time.
BOX, QUERIES = 64, 50_000
#: Boxes whose rows give the first bound of a query row's distance.
FIRST = 8
#: The k nearest fitted rows of a vector: squared distance, label, copies.
_NEAR = pa.struct([("far", pa.float64()), ("label", pa.float64()), ("n", pa.int64())])
_NEAR_SQL = "array<struct<far: double, label: double, n: bigint>>"


def fitted_points(frame: DataFrame, z: list[str], k: int, split_col: str = "split") -> DataFrame:
    """z, label, n: the frame's vectors with the labels and numbers (at most k) of
    their train rows; a vector's other rows are a row without a label."""
    label = F.when(F.col(split_col) == "train", F.col("label").cast("double"))
    points = frame.select(*z, label.alias("label")).groupBy(*z, "label").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    return stored(points, "points")


def _matrix(table: pa.Table | pa.RecordBatch, first: int, d: int) -> np.ndarray:
    return np.stack([table.column(first + i).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch)
                     else table.column(first + i).to_numpy() for i in range(d)], axis=1).astype(float)


def _halves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the rows, halved across the widest column until ``size`` or equal ones are left."""
    open_, done = [np.arange(len(x))], []
    while open_:
        at = open_.pop()
        wide = np.ptp(x[at], axis=0) if len(at) > size else np.zeros(1)
        if wide.max(initial=0) <= 0:
            done.append(at)
            continue
        at = at[np.argsort(x[at, int(wide.argmax())], kind="stable")]
        open_ += [at[:len(at) // 2], at[len(at) // 2:]]
    return done


@dataclass
class Boxes:
    """Fitted rows in boxes of near ones."""
    vectors: np.ndarray
    labels: np.ndarray
    copies: np.ndarray
    k: int
    starts: np.ndarray    # of the boxes' rows, and the end
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, labels: np.ndarray, copies: np.ndarray, k: int) -> Boxes:
        places = _halves(vectors, max(BOX, k))
        at = np.concatenate(places)
        return cls(vectors[at], labels[at], copies[at], k, np.cumsum([0, *map(len, places)]),
                   np.stack([vectors[p].min(axis=0) for p in places]), np.stack([vectors[p].max(axis=0) for p in places]))

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Predicted label of each row of ``x``: near query rows are compared with the
        boxes no farther than a distance within which each of them has k fitted rows."""
        out = np.empty(len(x))
        for at, q, some in self._parts(x):
            out[at] = vote(q, self.vectors[some], self.labels[some], self.copies[some], self.k)
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row of x, squared distance, label, copies) of the k nearest fitted rows of each
        row of ``x``, in that order."""
        found = [np.zeros((0, 4))]
        for at, q, some in self._parts(x):
            for a, row, *near in _nearest(q, self.vectors[some], self.labels[some], self.copies[some], self.k):
                if len(q) < len(at):  # equal rows
                    row, *near = np.repeat(at, len(row)), *(np.tile(v, len(at)) for v in near)
                else:
                    row = at[a + row]
                found.append(np.stack([row, *near], axis=1))
        all_ = np.concatenate(found)
        all_ = all_[np.argsort(all_[:, 0], kind="stable")]
        return all_[:, 0].astype(np.int64), all_[:, 1], all_[:, 2], all_[:, 3].astype(np.int64)

    def _parts(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of near query rows, those rows, fitted rows that hold their neighbours)."""
        kk, norms, sizes = min(self.k, len(self.vectors)), (self.vectors ** 2).sum(axis=1), np.diff(self.starts)
        for at in _halves(x, BOX) if len(x) else []:
            low, high = x[at].min(axis=0), x[at].max(axis=0)
            q = x[at] if (low < high).any() else x[at[:1]]  # equal rows are compared once
            least = np.zeros(len(sizes))
            for i in range(x.shape[1]):
                least += np.maximum(np.maximum(self.low[:, i] - high[i], low[i] - self.high[:, i]), 0.0) ** 2
            # the nearest boxes that have k rows, and a few more: they bound the neighbours' distance
            some = np.argpartition(least, FIRST)[:FIRST] if len(least) > FIRST else np.arange(len(least))
            if sizes[some].sum() < kk:
                order = np.argsort(least, kind="stable")
                some = order[:int(np.searchsorted(np.cumsum(sizes[order]), kk)) + 1]
            rows = self._rows(some)
            if len(rows) * len(q) > BLOCK:
                yield at, q, np.arange(len(self.vectors))
                continue
            qn = (q ** 2).sum(axis=1)
            reach = np.partition(qn[:, None] + norms[rows] - 2 * (q @ self.vectors[rows].T), kk - 1, axis=1)[:, kk - 1]
            reach = np.maximum(reach, 0.0) + 1e-9 * (1 + qn + norms[rows].max())
            near = np.flatnonzero(least <= reach.max())
            gap = np.zeros((len(q), len(near)))
            for i in range(x.shape[1] if x.shape[1] <= 12 else 0):
                gap += np.maximum(np.maximum(self.low[near, i] - q[:, i, None], q[:, i, None] - self.high[near, i]), 0.0) ** 2
            yield at, q, self._rows(near[(gap <= reach[:, None]).any(axis=0)])

    def _rows(self, boxes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[b], self.starts[b + 1]) for b in boxes])


def _nearest(x: np.ndarray, vectors: np.ndarray, labels: np.ndarray, copies: np.ndarray, k: int) -> Iterator[tuple]:
    """(first row, rows counted from it, squared distances, labels, copies) of the k nearest
    fitted rows of each row of ``x``, a block of rows at a time."""
    k = int(min(k, copies.sum()))
    kk = min(k, len(vectors))
    norms = (vectors ** 2).sum(axis=1)
    step = max(1, BLOCK // len(vectors))
    for a in range(0, len(x), step):
        q = x[a:a + step]
        qn = (q ** 2).sum(axis=1)
        rough = qn[:, None] + norms - 2 * (q @ vectors.T)
        edge = np.partition(rough, kk - 1, axis=1)[:, kk - 1]
        row, unit = np.nonzero(rough <= (edge + 1e-9 * (1 + qn + norms.max()))[:, None])
        exact = np.zeros(len(row))
        for i in range(x.shape[1]):
            exact += (q[row, i] - vectors[unit, i]) ** 2
        yield a, *_first(row, exact, labels[unit], copies[unit], k)


def _first(row: np.ndarray, far: np.ndarray, label: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each row's entries the k least by distance, then by label; the last one in part."""
    order = np.lexsort((label, far, row))
    row, far, label, n = row[order], far[order], label[order], n[order]
    start = np.searchsorted(row, row)
    before = np.cumsum(n) - n
    n = np.clip(k - (before - before[start]), 0, n)  # copies that are among the k nearest
    on = n > 0
    return row[on], far[on], label[on], n[on]


def _ballot(row: np.ndarray, label: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """The most frequent label of each row's entries, the smallest on ties."""
    classes, code = np.unique(label, return_inverse=True)
    pair, at = np.unique(row * max(len(classes), 1) + code, return_inverse=True)
    row, code, votes = pair // max(len(classes), 1), pair % max(len(classes), 1), np.bincount(at, n, len(pair))
    order = np.lexsort((code, -votes, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    out = np.full(rows, classes[0] if len(classes) else np.nan)
    out[row[first]] = classes[code[first]]
    return out


def vote(x: np.ndarray, vectors: np.ndarray, labels: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Predicted label of each row of ``x``."""
    out, step = np.empty(len(x)), max(1, BLOCK // len(vectors))
    for a, row, _, label, n in _nearest(x, vectors, labels, copies, k):
        rows = len(x[a:a + step])
        out[a:a + rows] = _ballot(row, label, n, rows)
    return out


def knn_predict(frame: DataFrame, d: int, k: int = 5, split_col: str = "split", few: int = FEW) -> DataFrame:
    """``frame`` plus ``prediction`` (the vote of the k nearest train rows,
    Euclidean distance on ``__z0..``) for every row; a train row is its own
    neighbour. Up to ``few`` fitted rows go to every task."""
    if k < 1:
        raise ValueError("k must be at least 1")
    z = [f"__z{i}" for i in range(d)]
    points = fitted_points(frame, z, k, split_col)
    n = points.where("label IS NOT NULL").count()
    if not n:
        raise ValueError("no train rows")
    if n > few:
        return _joined(frame, predict_leaves(points, d, k), z)
    rows = _matrix(points.where("label IS NOT NULL").select(*z, "label", "n").toArrow(), 0, d + 2)
    rows = rows[np.lexsort(rows.T[d::-1])]
    boxes = Boxes.of(rows[:, :d], rows[:, d], rows[:, d + 1].astype(np.int64), k)
    keep = [c for c in frame.columns if not c.startswith("__z")]
    n_keep = len(keep)
    schema = T.StructType([*[frame.schema[c] for c in keep], T.StructField("prediction", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches):
            x = np.concatenate([_matrix(b, n_keep, d) for b in some])
            found, a = boxes.vote(x), 0
            for b in some:
                yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], pa.array(found[a:a + b.num_rows])], names=[*keep, "prediction"])
                a += b.num_rows
    work, cores = frame.select(*keep, *z), frame.sparkSession.sparkContext.defaultParallelism
    if work.rdd.getNumPartitions() < cores:  # a small file has few splits
        work = work.repartition(cores)
    return work.mapInArrow(run, schema)


def _joined(frame: DataFrame, votes: DataFrame, z: list[str]) -> DataFrame:
    """Each row's prediction by its vector: sorted by a hash of it, compared in all columns."""
    keep = [c for c in frame.columns if not c.startswith("__z")]
    rows = frame.select(*keep, *z, F.xxhash64(*z).alias("__z"))
    votes = votes.select(*[F.col(c).alias(f"{c}v") for c in z], F.xxhash64(*z).alias("__zv"), "prediction")
    same = F.col("__z") == F.col("__zv")
    for c in z:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}v"))
    return rows.join(votes.hint("merge"), same).select(*keep, "prediction")


@dataclass
class Leaves:
    """A tree of cuts: an inner node sends what is up to its cut to ``left``, the rest to the next one."""
    column: np.ndarray    # -1 in a leaf
    cut: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, size: int) -> Leaves:
        """Halved across the widest column until ``size`` or equal rows are left."""
        column, cut, left, open_ = [-1], [0.0], [-1], [(0, np.arange(len(x)))]
        while open_:
            node, at = open_.pop()
            wide = np.ptp(x[at], axis=0) if len(at) > size else np.zeros(1)
            if not wide.max(initial=0) > 0:
                continue
            i = int(wide.argmax())
            v = np.sort(x[at, i])
            low = v[(len(v) - 1) // 2]
            if low == v[-1]:
                low = v[np.searchsorted(v, low) - 1]
            column[node], cut[node], left[node] = i, low, len(column)
            column, cut, left = [*column, -1, -1], [*cut, 0.0, 0.0], [*left, -1, -1]
            open_ += [(left[node], at[x[at, i] <= low]), (left[node] + 1, at[x[at, i] > low])]
        return cls(np.array(column), np.array(cut), np.array(left))

    def place(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf."""
        node, open_ = np.zeros(len(x), np.int64), np.arange(len(x)) if self.column[0] >= 0 else np.zeros(0, np.int64)
        while len(open_):
            at = node[open_]
            node[open_] = self.left[at] + ~(x[open_, self.column[at]] <= self.cut[at])
            open_ = open_[self.column[node[open_]] >= 0]
        return node


@dataclass
class Bounds:
    """Ranges of the leaves' fitted rows, and their number."""
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def others(self, x: np.ndarray, leaf: int, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, leaf): the other leaves that may hold a fitted row of a row's k nearest;
        ``reach``: the squared distance within which its own leaf has k (or infinite)."""
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in _halves(x, BOX) if len(x) else []:
            low, high, r = x[at].min(axis=0), x[at].max(axis=0), reach[at]
            if np.isinf(r).any():  # the nearest leaves that have k, to their farthest corners
                far = (np.maximum(np.abs(self.low - high), np.abs(self.high - low)) ** 2).sum(axis=1)
                order = np.argsort(far, kind="stable")
                enough = int(np.searchsorted(np.cumsum(self.rows[order]), k))
                r = np.minimum(r, far[order[enough]] if enough < len(far) else np.inf)
            gap = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
            near = np.flatnonzero(((gap ** 2).sum(axis=1) <= r.max() * (1 + 1e-9) + 1e-12) & (self.leaf != leaf))
            gap2 = np.zeros((len(at), len(near)))
            for i in range(x.shape[1]):
                q = x[at, i][:, None]
                gap2 += np.maximum(np.maximum(self.low[near, i] - q, q - self.high[near, i]), 0.0) ** 2
            row, to = np.nonzero(gap2 <= (r * (1 + 1e-9) + 1e-12)[:, None])
            rows.append(at[row])
            leaves.append(self.leaf[near[to]])
        return np.concatenate(rows), np.concatenate(leaves)


def _lists(row: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Lists of the values of rows 0 to n - 1; ``row`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _near_lists(row, far, label, copies, n: int) -> pa.Array:
    return _lists(row, n, pa.StructArray.from_arrays([pa.array(far), pa.array(label), pa.array(copies)], fields=list(_NEAR)))


def predict_leaves(points: DataFrame, d: int, k: int) -> DataFrame:
    """z, prediction: a row a vector of ``points``."""
    spark, z = points.sparkSession, [f"__z{i}" for i in range(d)]
    columns, kind = ", ".join(f"{c} double" for c in z), points.select(*z).schema
    n, cores = points.count(), spark.sparkContext.defaultParallelism
    wanted = max(-(-n // LEAF), 4 * cores if d <= 12 else cores)
    # where the cuts lie is of no account for any result
    marks = points.where(F.pmod(F.xxhash64(*z), F.lit(1 << 30)) < max(1, int(min(1.0, wanted * MARKS / n) * (1 << 30)))).select(*z).toArrow()
    tree = Leaves.of(_matrix(marks, 0, d), MARKS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.place(_matrix(b, 0, d)))], names=[*b.schema.names, "leaf"])

    placed = stored(points.select(*z, "label", "n").mapInArrow(place, f"{columns}, label double, n bigint, leaf bigint"), "leaves")
    got = placed.where("label IS NOT NULL").groupBy("leaf").agg(
        *[F.min(c).alias(f"a{i}") for i, c in enumerate(z)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(z)],
        F.sum("n").cast("double").alias("n")).orderBy("leaf").toArrow()
    bounds = Bounds(got["leaf"].to_numpy(), _matrix(got, 1, d), _matrix(got, 1 + d, d), got["n"].to_numpy())

    def boxes_of(table: pa.Table) -> Boxes | None:
        x, label = _matrix(table, 0, d), table.column("label").to_numpy()
        on = ~np.isnan(label)
        return Boxes.of(x[on], label[on], table.column("n").to_numpy()[on], k) if on.any() else None

    def nearest(boxes: Boxes | None, x: np.ndarray) -> tuple[np.ndarray, ...]:
        return boxes.nearest(x) if boxes else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))

    def home(table: pa.Table) -> pa.Table:
        x = np.unique(_matrix(table, 0, d), axis=0)
        row, far, label, copies = nearest(boxes_of(table), x)
        reach = np.full(len(x), np.inf)
        full = np.flatnonzero(np.bincount(row, copies, len(x)) >= k)
        reach[full] = far[np.searchsorted(row, full, "right") - 1]
        asks, leaves = bounds.others(x, table.column("leaf")[0].as_py(), reach, k)
        order = np.argsort(asks, kind="stable")
        asks, leaves = asks[order], leaves[order]
        done = np.bincount(asks, minlength=len(x)) == 0
        votes, on = _ballot(row, label, copies, len(x)), ~done[row]
        return pa.table([*[pa.array(c) for c in x.T], pa.array(votes, mask=~done), _lists(asks, len(x), pa.array(leaves)),
                         _near_lists(row[on], far[on], label[on], copies[on], len(x))], names=[*z, "prediction", "leaves", "near"])

    def ask(asking: pa.Table, table: pa.Table) -> pa.Table:
        x = _matrix(asking, 0, d)
        near = _near_lists(*nearest(boxes_of(table) if table.num_rows else None, x), len(x))
        return pa.table([*[pa.array(c) for c in x.T], near], names=[*z, "near"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = b.column(d)
            lens = near.value_lengths().to_numpy(zero_copy_only=False)
            far, label, copies = (near.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            row, _, label, copies = _first(np.repeat(np.arange(b.num_rows), lens), far, label, copies, k)
            yield pa.RecordBatch.from_arrays([*b.columns[:d], pa.array(_ballot(row, label, copies, b.num_rows))], names=[*z, "prediction"])

    first = stored(placed.repartition(wanted, "leaf").groupBy("leaf").applyInArrow(
        home, f"{columns}, prediction double, leaves array<bigint>, near {_NEAR_SQL}"), "home")
    open_ = first.where("prediction IS NULL")
    asks = open_.select(*z, F.explode("leaves").alias("leaf"))
    parts = asks.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    parts = stored(parts, "parts")  # a row a leaf
    asking = (asks.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64(*z), F.col("parts")).cast("int"))
              .select(*z, "leaf", "part").repartition(wanted, "leaf", "part"))
    asked = (placed.where("label IS NOT NULL").join(F.broadcast(parts), "leaf")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(*z, "label", "n", "leaf", "part").repartition(wanted, "leaf", "part"))
    answers = asking.groupBy("leaf", "part").cogroup(asked.groupBy("leaf", "part")).applyInArrow(ask, f"{columns}, near {_NEAR_SQL}")
    merged = (open_.select(*z, "near").unionByName(answers).groupBy(*z).agg(F.flatten(F.collect_list("near")).alias("near"))
              .mapInArrow(count, T.StructType([*kind.fields, T.StructField("prediction", T.DoubleType())])))
    return stored(first.where("prediction IS NOT NULL").select(*z, "prediction").unionByName(merged), "votes")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    some: list[pa.RecordBatch] = []
    for b in batches:
        some.append(b)
        if sum(s.num_rows for s in some) >= QUERIES:
            yield some
            some = []
    if some:
        yield some
