"""Linear discriminant analysis.

One pass gives per-class counts and sums and the sums of products of all rows,
from which the pooled within-class scatter follows.  The driver
solves the d x d problem the SVD way: whiten by the within-class
scatter, then take the principal axes of the class means.  Projections
and class scores are matrix products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import numeric_cols, pround
from tessera.functions.frames import stored
from tessera.functions.linalg import add_up, fix_signs, linear_columns
from tessera.operators import metrics as M
from tessera.operators.models import model_frame
from tessera.operators.split import can_stratify, train_test_split

MAX_CLASSES = 1000


@dataclass
class LDAModel:
    d: int
    classes: list
    xbar: np.ndarray
    scalings: np.ndarray      # d x n_comp
    ratio: np.ndarray
    coef: np.ndarray          # K x d
    intercept: np.ndarray     # K

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        z = [F.col(f"__z{i}") - F.lit(float(self.xbar[i])) for i in range(self.d)]
        ld = linear_columns(z, self.scalings, [f"LD{j + 1}" for j in range(self.scalings.shape[1])])
        return df.select(*keep, *ld)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: the class of the highest score, the first of equal ones."""
        coef, intercept = self.coef, self.intercept

        @F.pandas_udf("double")
        def best(x: pd.Series) -> pd.Series:
            return pd.Series((np.array(x.tolist(), dtype=float) @ coef.T + intercept).argmax(axis=1).astype(float))

        return df.withColumn("prediction", best(F.array(*[F.col(f"__z{i}") for i in range(self.d)])))


def _class_sums(train: DataFrame, d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and column sums of each class, and the sums of products of all rows, in one pass."""
    def run(batches):
        total = np.zeros((k + d, d + 1))
        for b in batches:
            lab = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.stack([b.column(1 + j).to_numpy(zero_copy_only=False) for j in range(d)], axis=1).astype(float)
            hot = np.zeros((len(x), k))
            hot[np.arange(len(x)), lab] = 1.0
            total[:k, 0] += hot.sum(axis=0)
            total[:k, 1:] += hot.T @ x
            total[k:, 1:] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + d, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "s"])

    rows = train.select(F.col("label").cast("double"), *[F.col(f"__z{i}").cast("double") for i in range(d)])
    total = add_up(rows.mapInArrow(run, "i int, s array<double>"), k + d, d + 1, rows.rdd.getNumPartitions())
    return total[:k, 0], total[:k, 1:], total[k:, 1:]


# The two-step solution (whiten the within-class scatter, then rotate to the
# between-class axes) is the textbook one, arranged as in scikit-learn's "svd"
# solver (BSD 3-clause licence), from which its tolerances are taken too.
def fit_lda(train: DataFrame, d: int, classes: list, tol: float = 1e-4) -> LDAModel:
    k = len(classes)
    if k > MAX_CLASSES:
        raise ValueError("too many classes")
    rows, sums, products = _class_sums(train, d, k)
    labels = np.flatnonzero(rows).tolist()
    counts = rows[labels]
    means = sums[labels] / np.maximum(counts, 1)[:, None]
    n = counts.sum()
    if n <= len(labels):
        raise ValueError("discriminant analysis needs more rows than classes")
    priors = counts / n
    # the features are standardised, so little cancels here
    within = products - (means * counts[:, None]).T @ means
    within[np.diag_indices(d)] = np.maximum(np.diag(within), 0.0)
    flat = np.diag(within) <= 1e-12 * np.maximum(np.diag(products), 1e-300)
    within[flat], within[:, flat] = 0.0, 0.0
    std = np.sqrt(np.diag(within) / n)
    std[std == 0] = 1.0
    fac = 1.0 / (n - len(labels))
    gram = fac * within / np.outer(std, std)
    vals, vecs = np.linalg.eigh(gram)
    order = np.argsort(vals)[::-1]
    s = np.sqrt(np.clip(vals[order], 0, None))
    vecs = vecs[:, order]
    rank = int(np.sum(s > tol))
    scal = (vecs[:, :rank] / std[:, None]) / s[:rank]
    xbar = priors @ means
    fac2 = 1.0 if len(labels) == 1 else 1.0 / (len(labels) - 1)
    xb = (np.sqrt(n * priors * fac2)[:, None] * (means - xbar)) @ scal
    _, s2, vt2 = np.linalg.svd(xb, full_matrices=False)
    n_comp = min(len(labels) - 1, d)
    ratio = (s2 ** 2 / np.sum(s2 ** 2))[:n_comp]
    rank2 = int(np.sum(s2 > tol * s2[0]))
    scal = scal @ vt2.T[:, :rank2]
    coef = (means - xbar) @ scal
    intercept = -0.5 * np.sum(coef ** 2, axis=1) + np.log(priors)
    coef = coef @ scal.T
    intercept = intercept - xbar @ coef.T
    full_coef = np.zeros((k, d))
    full_int = np.full(k, -np.inf)
    for i, lab in enumerate(labels):
        full_coef[lab], full_int[lab] = coef[i], intercept[i]
    full_int[~np.isfinite(full_int)] = -1e300
    return LDAModel(d, classes, xbar, fix_signs(scal[:, :n_comp]), ratio, full_coef, full_int)


def lda_analysis(df: DataFrame, target: str, feats: list[str] | None = None, test_size: float = 0.2,
                 seed: int = 42, key: list[str] | None = None):
    """Fit on the train split, transform all rows.  Returns a dict of
    DataFrames: scores (LD1.. + target + split), variance (component,
    explained_variance_pct, cumulative_pct), report, confusion, metrics,
    accuracy (train / test), predictions (actual, predicted, LD1..5)."""
    feats = feats or [c for c in numeric_cols(df) if c != target]
    frame, classes = model_frame(df, feats, target, key=key)
    if len(classes) < 2:
        raise ValueError("LDA needs at least two classes")
    strat = target if can_stratify(frame, target) else None
    s = train_test_split(frame, test_size, seed, key=key or None, stratify=strat)
    s = stored(s, "lda-split")
    model = fit_lda(s.where(F.col("split") == "train"), len(feats), classes)
    pred = model.predict(s)
    scores = model.transform(pred, list(dict.fromkeys([target, "split", "label", "prediction"])))
    scores = stored(scores, "lda-scores")
    cum = np.cumsum(model.ratio)
    spark = df.sparkSession
    var = spark.createDataFrame([(f"LD{j + 1}", pround(model.ratio[j] * 100, 2), pround(cum[j] * 100, 2))
                                 for j in range(len(model.ratio))],
                                "component string, explained_variance_pct double, cumulative_pct double")
    names = F.array(*[F.lit(c) for c in classes])
    named = scores.select("*", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))
    test = named.where(F.col("split") == "test")
    n_ld = len(model.ratio)
    return {
        "model": model, "split": s,
        "scores": scores.select(*[f"LD{j + 1}" for j in range(n_ld)], target, "split"),
        "variance": var,
        "report": M.class_report(test, target, "predicted"),
        "confusion": M.confusion(test, target, "predicted"),
        "metrics": M.metrics(test, target, "predicted"),
        "accuracy": M.accuracy_by_split(named, target, "predicted"),
        "predictions": test.select(F.col(target).alias("actual"), "predicted",
                                   *[f"LD{j + 1}" for j in range(min(n_ld, 5))]),
    }
