"""Gradient-boosted trees for any number of classes in one softmax (M7).

A stage grows one small regression tree a class on the residuals of the joint
softmax, as in Friedman (2001): start at the log shares of the classes, split by
least squares, leaves by one Newton step. All classes' trees grow together: a pass
over the train rows gives the histograms of every class, node, column and bin of a
level, so a stage takes ``depth`` passes however many classes there are. Rows are
bin numbers (a byte a column) with their margins; rows of one label and equal bin
numbers are alike to every tree, so they are one row with a count. Trees grown since
the margins were last written are applied on the way. The driver sees histograms,
whose size does not depend on the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frames import stored
from tessera.functions.linalg import add_up

BINS = 32
#: Stages after which the rows' margins are written anew.
REFRESH = 10
#: Counted rows that one task takes through a pass.
TASK_ROWS = 20_000


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Stage:
    """One tree a class, complete to its depth: node j's children are 2j+1 and 2j+2."""
    feature: np.ndarray   # classes x nodes; -1: all rows go left
    code: np.ndarray      # last bin that goes left
    leaf: np.ndarray      # classes x leaves, learning rate included

    def places(self, codes: np.ndarray, k: int, levels: int) -> np.ndarray:
        """Node of each row among those of a level of class k's tree."""
        at = np.zeros(len(codes), np.int64)
        for level in range(levels):
            node = at + (1 << level) - 1
            f = self.feature[k, node]
            right = (f >= 0) & (codes[np.arange(len(codes)), np.maximum(f, 0)] > self.code[k, node])
            at = 2 * at + right
        return at

    def add_to(self, codes: np.ndarray, margins: np.ndarray) -> None:
        depth = int(np.log2(self.leaf.shape[1]))
        for k in range(len(self.leaf)):
            margins[:, k] += self.leaf[k, self.places(codes, k, depth)]


@dataclass
class Boosted:
    cuts: list[np.ndarray]    # a column's bin edges; bin b holds values up to edge b
    start: np.ndarray
    stages: list[Stage]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Rows of equal bin numbers go through the trees once."""
        codes, of = _distinct(self.codes(x))
        out = np.tile(self.start, (len(codes), 1))
        for s in self.stages:
            s.add_to(codes, out)
        return out[of]

    def predict(self, df: DataFrame, d: int) -> DataFrame:
        """Adds ``prediction``: the class number of the largest margin (the first of equal ones)."""
        me = self

        @F.pandas_udf("double")
        def best(*x: pd.Series) -> pd.Series:
            return pd.Series(me.margins(np.stack([c.to_numpy(float) for c in x], axis=1)).argmax(axis=1).astype(float))

        return df.withColumn("prediction", best(*[F.col(f"__z{i}") for i in range(d)]))


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different rows, which of them each row is)."""
    keys = np.ascontiguousarray(codes.astype(np.uint8))
    keys = keys.view(f"V{keys.shape[1]}").ravel() if keys.shape[1] else np.zeros(len(keys), "V1")
    _, at, of = np.unique(keys, return_index=True, return_inverse=True)
    return codes[at], of


def _split(g: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Best (column, last bin to the left) of a node's sums (columns x bins), the
    first of equal gains; (-1, 0) where nothing is gained."""
    gl, nl = g.cumsum(axis=1)[:, :-1], n.cumsum(axis=1)[:, :-1]
    total, rows = g.sum(axis=1)[:, None], n.sum(axis=1)[:, None]
    gr, nr = total - gl, rows - nl
    both = (nl > 0) & (nr > 0)
    gain = np.where(both, gl ** 2 / np.maximum(nl, 1) + gr ** 2 / np.maximum(nr, 1) - total ** 2 / np.maximum(rows, 1), -np.inf)
    if not gain.size or gain.max() <= 1e-12:
        return -1, 0
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(f), int(b)


def _read(batch: pa.RecordBatch, d: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, bin numbers, margins and counts."""
    n = batch.num_rows
    codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, d)
    return (batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), codes,
            np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(n, classes).copy(),
            batch.column(3).to_numpy(zero_copy_only=False).astype(float))


def _encode(model: Boosted, d: int):
    """(label, codes, n): a batch's rows of one label and equal codes are one row."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(1 + j).to_numpy(zero_copy_only=False) for j in range(d)], axis=1).astype(float)
            codes, of = _distinct(model.codes(x))
            labels, label = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            cells, n = np.unique(label * len(codes) + of, return_counts=True)
            found = [codes[i].astype(np.uint8).tobytes() for i in cells % len(codes)]
            yield pa.RecordBatch.from_arrays([pa.array(labels[cells // len(codes)]), pa.array(found, pa.binary()), pa.array(n.astype(np.int64))],
                                             names=["label", "codes", "n"])
    return run


def _apply(stages: list[Stage], d: int, classes: int):
    def run(batches):
        for b in batches:
            _, codes, margins, _ = _read(b, d, classes)
            for s in stages:
                s.add_to(codes, margins)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m.astype("<f8").tobytes() for m in margins], pa.binary()),
                                              b.column(3)], names=["label", "codes", "margins", "n"])
    return run


def _histograms(stages: list[Stage], tree: Stage, level: int, d: int, classes: int, bins: int):
    """Per task, of every class and node of a level: sums of residuals, rows and
    Newton weights by column and bin."""
    nodes = 1 << level

    def run(batches):
        total = np.zeros((classes * nodes, 3, d, bins))
        for b in batches:
            y, codes, margins, n = _read(b, d, classes)
            for s in stages:
                s.add_to(codes, margins)
            r = (np.arange(classes) == y[:, None]) - softmax(margins)
            weight = np.abs(r) * (1 - np.abs(r))
            for k in range(classes):
                at = tree.places(codes, k, level)
                for j in range(d):
                    cell = at * bins + codes[:, j]
                    for v, values in enumerate((n * r[:, k], n, n * weight[:, k])):
                        total[k * nodes:(k + 1) * nodes, v, j] += np.bincount(cell, values, minlength=nodes * bins).reshape(nodes, bins)
        on = np.flatnonzero(total[:, 1].any(axis=(1, 2)))
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(list(total[on].reshape(len(on), -1)), pa.list_(pa.float64()))],
                                             names=["i", "s"])
    return run


def fit_boosted(train: DataFrame, d: int, classes: int, stages: int = 100, depth: int = 3, rate: float = 0.1,
                bins: int = BINS, cuts: list[np.ndarray] | None = None) -> Boosted:
    """From rows with ``label`` (0 .. classes - 1) and ``__z0`` .. without NULLs.
    Bin edges are quantiles of the train rows (a sketch) unless given."""
    if bins > 256:
        raise ValueError("at most 256 bins")
    z = [f"__z{i}" for i in range(d)]
    if cuts is None:
        found = train.approxQuantile(z, [(i + 1) / bins for i in range(bins - 1)], 0.1 / bins)
        cuts = [np.unique(np.array(c, float)) for c in found]
    shares = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}
    n = sum(shares.values())
    if not n:
        raise ValueError("no rows to train on")
    start = np.log(np.maximum([shares.get(k, 0) for k in range(classes)], 1e-9 * n) / n)
    model = Boosted(cuts, start, [])
    schema = "label double, codes binary, margins binary, n long"
    rows = train.select(F.col("label").cast("double"), *[F.col(c).cast("double") for c in z]).mapInArrow(_encode(model, d), "label double, codes binary, n long")
    rows = stored(rows.groupBy("label", "codes").agg(F.sum("n").alias("n")), "boosting")
    parts = max(1, min(-(-rows.count() // TASK_ROWS), max(train.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())))
    rows = rows.select("label", "codes", F.lit(model.start.astype("<f8").tobytes()).alias("margins"), "n")
    rows = rows.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    recent: list[Stage] = []
    for t in range(stages):
        tree = Stage(np.full((classes, (1 << depth) - 1), -1), np.zeros((classes, (1 << depth) - 1), np.int64), np.zeros((classes, 1 << depth)))
        for level in range(depth):
            nodes = 1 << level
            got = add_up(rows.mapInArrow(_histograms(recent, tree, level, d, classes, bins), "i int, s array<double>"),
                         classes * nodes, 3 * d * bins, parts).reshape(classes, nodes, 3, d, bins)
            for k in range(classes):
                for j in range(nodes):
                    g, m, w = got[k, j]
                    f, b = _split(g, m)
                    tree.feature[k, nodes - 1 + j], tree.code[k, nodes - 1 + j] = f, b
                    if level == depth - 1:  # the last level's bins tell the leaves' sums
                        sides = [(g[f, :b + 1].sum(), w[f, :b + 1].sum()), (g[f, b + 1:].sum(), w[f, b + 1:].sum())] if f >= 0 else [
                            (g[0].sum(), w[0].sum()), (0.0, 0.0)]
                        for side, (num, den) in enumerate(sides):
                            tree.leaf[k, 2 * j + side] = rate * (classes - 1) / classes * num / den if den > 1e-150 else 0.0
        model.stages.append(tree)
        recent.append(tree)
        if len(recent) == REFRESH and t + 1 < stages:
            old, rows = rows, stored(rows.mapInArrow(_apply(recent, d, classes), schema), "boosting").repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
            old.unpersist()
            recent = []
    rows.unpersist()
    return model
