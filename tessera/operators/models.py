"""Classifier comparison on an exact train/test split.

Features are mean-imputed and standardised with built-in Columns, the
split is the exact hash-ranked split, and every estimator is a
distributed ``pyspark.ml`` learner; only model coefficients and k x k
count tables reach the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import (LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col, numeric_cols
from tessera.functions.frames import stored
from tessera.functions.linalg import prepare
from tessera.operators import metrics as M
from tessera.operators.boosting import fit_boosted
from tessera.operators.kernel import KernelMap, fit_kernel
from tessera.operators.neighbors import knn_predict
from tessera.operators.split import can_stratify, train_test_split

MODELS = ["logistic", "random_forest", "gradient_boosting", "svm", "knn"]
_NAMES = {"logistic": "Logistic Regression", "random_forest": "Random Forest",
          "gradient_boosting": "Gradient Boosting", "svm": "SVM", "knn": "K-Nearest Neighbors"}


def model_frame(df: DataFrame, feats: list[str], target: str, fit_rows: DataFrame | None = None,
                scale: bool = True, key: list[str] | None = None):
    """Mean-impute over all rows, drop rows without a target, standardise
    over the remaining rows.  Returns (frame with __z0.., target, key
    columns; classes sorted)."""
    prep = prepare(df, feats, False)
    z = prep.columns(df, "__i")
    key = [k for k in (key or []) if k not in feats and k != target]
    base = df.select(*[col(k) for k in key], col(target).alias(target), *z).where(col(target).isNotNull())
    imp = [f"__i{i}" for i in range(len(feats))]
    if scale:
        st = base.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(imp)],
                      *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(imp)]).collect()[0]
        zs = [((F.col(c) - F.lit(st[f"m{i}"] or 0.0)) / F.lit(st[f"s{i}"] or 1.0)).alias(f"__z{i}")
              for i, c in enumerate(imp)]
    else:
        zs = [F.col(c).alias(f"__z{i}") for i, c in enumerate(imp)]
    frame = base.select(*[col(k) for k in key], col(target), *zs)
    classes = _classes(frame, target)
    lab = F.array_position(F.array(*[F.lit(c) for c in classes]), col(target).cast("string")) - 1
    return frame.withColumn("label", lab.cast("double")), classes


#: Depth of the forest's trees: Spark's own limit, as the method sets none.
FOREST_DEPTH = 30
#: Rows from which the fits' input is dealt out over the cores, where a file has fewer splits.
SPREAD_ROWS = 100_000
#: Train rows from which a kernel machine is fitted on merged rows.
MERGE_ROWS = 1_000_000
#: Bytes of merged rows' features that a task of its fits holds, about.
FIT_BYTES = 1 << 25
#: Classes a model may have; their names go into the plan.
MAX_CLASSES = 1000


def _classes(frame: DataFrame, target: str) -> list:
    rows = frame.select(col(target).cast("string")).where(col(target).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return sorted(r[0] for r in rows)


def estimator(name: str, n_train: int, seed: int = 42, rf_depth: int = FOREST_DEPTH):
    if name == "logistic":
        # sklearn C = 1 on a summed loss == Spark regParam 1 / n on a mean loss
        return LogisticRegression(family="multinomial", regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, maxIter=1000, tol=1e-4)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=100, maxDepth=rf_depth, seed=seed, featureSubsetStrategy="sqrt")
    if name == "svm":
        return OneVsRest(classifier=LinearSVC(regParam=1.0 / max(n_train, 1), maxIter=100, tol=1e-4,
                                              standardization=False), parallelism=8)
    raise ValueError(f"unknown model {name}")


def fit_predict(name: str, split_df: DataFrame, d: int, seed: int = 42, gamma: float | str = "scale") -> DataFrame:
    """Fit on the train rows, predict every row; adds ``prediction``.  The kernel
    machine is linear in the features of ``kernel.fit_kernel``.  The
    assembled feature vectors are persisted once, so iterative learners do
    not recompute the split lineage on every pass."""
    from pyspark.ml.functions import array_to_vector
    keep = [c for c in split_df.columns if not c.startswith("__z")]
    if name == "knn":
        return stored(knn_predict(split_df, d, k=5), "predictions")
    if name == "gradient_boosting":
        train = split_df.where(F.col("split") == "train")
        classes = int(split_df.agg(F.max("label")).first()[0] or 0) + 1
        return stored(fit_boosted(train, d, classes).predict(split_df, d).select(*keep, "prediction"), "predictions")
    if name == "svm":
        cols = [f"__z{i}" for i in range(d)]
        train = split_df.where(F.col("split") == "train")
        found = fit_kernel(train, cols, gamma, seed=seed)
        if train.count() > MERGE_ROWS:
            return stored(_merged_svm(split_df, found, cols, keep, seed), "predictions")
        frame = found.transform(split_df, cols, "__k").select(*keep, array_to_vector("__k").alias("features"))
    else:
        asm = VectorAssembler(inputCols=[f"__z{i}" for i in range(d)], outputCol="features")
        frame = asm.transform(split_df).select(*keep, "features")
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = frame.where(F.col("split") == "train")
        n_train = train.count()
        model = estimator(name, n_train, seed).fit(train)
        pred = stored(model.transform(frame).select(*keep, "prediction"), "predictions")
    finally:
        frame.unpersist()
    return pred


def _merged_svm(split_df: DataFrame, found: KernelMap, cols: list[str], keep: list[str], seed: int) -> DataFrame:
    """``split_df`` plus the kernel machine's ``prediction``: train rows that are equal go into the
    fit as one with their number as its weight, which leaves the loss as it is; rows to predict
    become scores a block at a time, and no features of theirs are kept."""
    from pyspark.ml.functions import array_to_vector
    equal = stored(split_df.where(F.col("split") == "train").groupBy(*cols, "label").agg(F.count(F.lit(1)).cast("double").alias("weight")), "equal")
    # every iteration is a job: no more tasks than their features are worth
    equal = equal.repartition(-(-equal.count() * found.root.shape[1] * 8 // FIT_BYTES) or 1)
    frame = found.transform(equal, cols, "__k").select("label", "weight", array_to_vector("__k").alias("features"))
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_train = int(frame.agg(F.sum("weight")).first()[0])
        # a class at a time: each fit keeps blocks of its own
        model = estimator("svm", n_train, seed).setWeightCol("weight").setParallelism(1).fit(frame)
    finally:
        frame.unpersist()
    weights = np.stack([m.coefficients.toArray() for m in model.models], axis=1)
    start, n_keep = np.array([m.intercept for m in model.models]), len(keep)

    def run(batches):
        for b in batches:
            x = np.stack([b.column(n_keep + i).to_numpy(zero_copy_only=False) for i in range(len(cols))], axis=1)
            best = [(found.features(part) @ weights + start).argmax(axis=1) for part in found.blocks(x)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], pa.array(np.concatenate(best).astype(float))], names=[*keep, "prediction"])

    schema = T.StructType([*[split_df.schema[c] for c in keep], T.StructField("prediction", T.DoubleType())])
    return split_df.select(*keep, *cols).mapInArrow(run, schema)


def split_frame(df: DataFrame, feats: list[str], target: str, test_size: float = 0.2, seed: int = 42,
                key: list[str] | None = None):
    frame, classes = model_frame(df, feats, target, key=key)
    strat = target if can_stratify(frame, target) else None
    s = spread(train_test_split(frame, test_size, seed, key=key or None, stratify=strat), frame)
    return s.persist(StorageLevel.MEMORY_AND_DISK), classes


def spread(s: DataFrame, counted: DataFrame) -> DataFrame:
    """``s`` dealt out over the cores if it has many rows (as many as ``counted``) in few partitions."""
    cores = s.sparkSession.sparkContext.defaultParallelism
    if s.rdd.getNumPartitions() >= cores or counted.count() < SPREAD_ROWS:
        return s
    return s.repartition(cores)


def compare_models(df: DataFrame, target: str, feats: list[str] | None = None,
                   models: list[str] | None = None, test_size: float = 0.2, seed: int = 42,
                   key: list[str] | None = None):
    """(model, train_accuracy, test_accuracy, precision_macro,
    recall_macro, f1_macro) per model and the best model's test
    predictions (highest test accuracy, first wins ties)."""
    feats = feats or [c for c in numeric_cols(df) if c != target]
    models = models or ["logistic", "random_forest", "knn"]
    s, classes = split_frame(df, feats, target, test_size, seed, key)
    rows, best, best_acc = [], None, -1.0
    try:
        rows_of = s.drop(*[k for k in key or [] if k not in (target, "label", "split")])  # the split alone needs them
        for name in models:
            pred = fit_predict(name, rows_of, len(feats), seed)
            acc = {r["split"]: r["accuracy"] for r in
                   M.accuracy_by_split(pred, "label", "prediction").collect()}
            exact = pred.where(F.col("split") == "test").agg(
                F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] or 0.0
            m = M.metrics(pred.where(F.col("split") == "test"), "label", "prediction").collect()[0]
            rows.append((_NAMES[name], acc.get("train"), acc.get("test"), m["precision_macro"],
                         m["recall_macro"], m["f1_macro"]))
            if exact > best_acc:  # unrounded; the first wins ties
                best, best_acc = (name, pred), exact
    finally:
        s.unpersist()
    table = df.sparkSession.createDataFrame(
        rows, "model string, train_accuracy double, test_accuracy double, precision_macro double, "
              "recall_macro double, f1_macro double")
    return table, (best[0] if best else None), (prediction_table(best[1], classes) if best else None)


def prediction_table(pred: DataFrame, classes: list, extra: list[str] | None = None,
                     split: str = "test") -> DataFrame:
    """(actual, predicted[, extra...]) for the ``split`` rows, labels
    mapped back to class names."""
    names = F.array(*[F.lit(c) for c in classes])
    p = pred.where(F.col("split") == split) if split else pred
    return p.select(F.element_at(names, F.col("label").cast("int") + 1).alias("actual"),
                    F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"),
                    *[col(e) for e in (extra or [])])


def classify_components(scores: DataFrame, comps: list[str], target: str, model: str = "logistic",
                        test_size: float = 0.2, seed: int = 42, key: list[str] | None = None,
                        show: int = 5) -> dict:
    """Classifier on component scores (PCA / factor scores fitted on all
    rows, as the reference does): rows without a target dropped, exact
    stratified split when every class has two rows, then metrics, report,
    confusion, train/test accuracy and a prediction table with the first
    ``show`` components."""
    key = [k for k in (key or []) if k not in comps and k != target]
    base = scores.where(col(target).isNotNull())
    classes = _classes(base, target)
    if len(classes) < 2:
        raise ValueError("need at least two classes")
    lab = F.array_position(F.array(*[F.lit(c) for c in classes]), col(target).cast("string")) - 1
    frame = base.select(*[col(k) for k in key], col(target), *[col(c).alias(f"__z{i}") for i, c in enumerate(comps)],
                        *[col(c) for c in comps[:show]]).withColumn("label", lab.cast("double"))
    strat = target if can_stratify(frame, target) else None
    s = train_test_split(frame, test_size, seed, key=key or None, stratify=strat)
    s = s.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        pred = fit_predict(model, s, len(comps), seed)
    finally:
        s.unpersist()
    names = F.array(*[F.lit(c) for c in classes])
    named = pred.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))
    test = named.where(F.col("split") == "test")
    return {"metrics": M.metrics(test, target, "predicted"), "report": M.class_report(test, target, "predicted"),
            "confusion": M.confusion(test, target, "predicted"),
            "accuracy": M.accuracy_by_split(named, target, "predicted"),
            "predictions": test.select(F.col(target).alias("actual"), "predicted", *comps[:show])}
