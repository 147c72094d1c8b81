"""Classification evaluation from a prediction DataFrame.

Everything derives from the (label, prediction) count table, at most
classes^2 rows, so evaluation costs one grouped aggregation however many
rows were scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, rnd
from tessera.functions.ranking import grid


def _counts(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    return (pred.groupBy(col(label).cast("string").alias("actual"),
                         col(prediction).cast("string").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Tall confusion matrix (actual, predicted, n) over the sorted union
    of labels, zero cells kept."""
    counts = _counts(pred, label, prediction)
    cls = counts.select(F.explode(F.array("actual", "predicted")).alias("actual")).distinct().where("actual IS NOT NULL")
    cells = grid(cls, cls.select(F.col("actual").alias("predicted")))
    return (cells.join(counts, on=["actual", "predicted"], how="left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")))


def _per_class(counts: DataFrame) -> DataFrame:
    tp = counts.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"),
                                                                    F.col("n").alias("tp"))
    sup = counts.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    prd = counts.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("pred"))
    allc = sup.select("cls").unionByName(prd.select("cls")).distinct()
    pc = (allc.join(tp, "cls", "left").join(sup, "cls", "left").join(prd, "cls", "left")
          .na.fill(0, ["tp", "support", "pred"]))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    pc = pc.select("cls", p.alias("precision"), r.alias("recall"), "support", "tp")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return pc.withColumn("f1_score", f1)


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                 digits: int = 4) -> DataFrame:
    """(class, precision, recall, f1_score, support) per class plus rows
    'accuracy' (all three scores = accuracy, support = rows), 'macro avg'
    and 'weighted avg'; zero divisions count as 0."""
    pc = _per_class(_counts(pred, label, prediction))
    tot = pc.agg(F.sum("support").alias("N"), F.sum("tp").alias("TP"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                 F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                 F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                 F.try_divide(F.sum(F.col("f1_score") * F.col("support")), F.sum("support")).alias("wf"))
    acc = F.try_divide(F.col("TP").cast("double"), F.col("N"))
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1_score"), F.col("N").alias("support")),
        *[F.struct(F.lit(nm).alias("class"), F.col(a).alias("precision"), F.col(b).alias("recall"),
                   F.col(c).alias("f1_score"), F.col("N").alias("support"))
          for nm, a, b, c in (("macro avg", "mp", "mr", "mf"), ("weighted avg", "wp", "wr", "wf"))])).alias("s")
    ).select("s.*")
    rows = pc.select(F.col("cls").alias("class"), "precision", "recall", "f1_score", "support")
    out = rows.unionByName(summary)
    return out.select("class", *[rnd(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("long").alias("support"))


def metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
            digits: int = 4) -> DataFrame:
    """One row: accuracy and macro precision / recall / F1."""
    pc = _per_class(_counts(pred, label, prediction))
    return pc.agg(rnd(F.try_divide(F.sum("tp").cast("double"), F.sum("support")), digits).alias("accuracy"),
                  rnd(F.avg("precision"), digits).alias("precision_macro"),
                  rnd(F.avg("recall"), digits).alias("recall_macro"),
                  rnd(F.avg("f1_score"), digits).alias("f1_macro"))


def accuracy_by_split(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                      split: str = "split", digits: int = 4) -> DataFrame:
    """(split, accuracy) e.g. train vs test."""
    ok = (col(label).cast("string") == col(prediction).cast("string")).cast("double")
    return pred.groupBy(col(split)).agg(rnd(F.avg(ok), digits).alias("accuracy"))
