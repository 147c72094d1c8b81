"""Train/test split with exact sizes (M1-M3)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col, rnd
from tessera.functions.frames import stored
from tessera.functions.ranking import cuts, positions, small
from tessera.operators.sampling import hash_long

_STRATUM = "__stratum"
_ORDER = "__order"


def stratify_check(df: DataFrame, target: str) -> DataFrame:
    """One row: ``can_stratify`` = every class has at least two rows."""
    return (df.groupBy(col(target)).count()
            .agg(F.coalesce(F.min("count") >= 2, F.lit(False)).alias("can_stratify")))


def can_stratify(df: DataFrame, target: str) -> bool:
    return bool(stratify_check(df, target).collect()[0]["can_stratify"])


def _allocate(classes: DataFrame, n_test: int, n: int) -> DataFrame:
    """Largest-remainder split of ``n_test`` rows over ``classes`` (class, count),
    ties by class: (class, want), in whole numbers and without a limit on classes."""
    share = F.col("count").cast("decimal(19,0)") * F.lit(n_test).cast("decimal(19,0)")
    quota = stored(classes.select(_STRATUM, share.alias("share")).withColumn("floor", F.expr(f"CAST(share div {n} AS BIGINT)"))
                   .select(_STRATUM, "floor", F.expr(f"share - CAST(floor AS DECIMAL(38,0)) * {n}").alias("rest"),
                           F.lit(1).cast("long").alias("one")), "strata")
    left = n_test - quota.agg(F.sum("floor")).first()[0]
    if left:
        quota = positions(quota, [F.col("rest").desc(), F.col(_STRATUM)], "one")
        quota = quota.withColumn("floor", F.col("floor") + (F.col("__before") < left).cast("long"))
    return quota.where("floor > 0").select(_STRATUM, F.col("floor").alias("want"))


def _sortable(df: DataFrame, name: str) -> Column:
    """The column as it is where Spark can order it; NaN counts as NULL."""
    c, t = col(name), df.schema[name].dataType
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.nanvl(c, F.lit(None).cast(t))
    return c if _orderable(t) else c.cast("string")


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _orderable(t.elementType)
    return not isinstance(t, (T.MapType, T.VariantType))


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                     key: list[str] | None = None, stratify: str | None = None,
                     shuffle: bool = True, order_by: str | None = None) -> DataFrame:
    """``df`` plus a ``split`` column ('train' / 'test') with exactly
    ceil(n * test_size) test rows; every row comes back, NULLs included.

    Shuffled: the rows with the smallest 52-bit md5 of (key, seed) are the test
    rows, ties by key. Not shuffled: the last rows by ``order_by``, then by key
    (NULLs count as first). Stratified: the test count is spread over classes by
    largest remainder and each class is cut at its own exact rank.

    The order is that of the real columns, of any type. Each class's cut is the
    value at its rank among the first column's counted values; only rows with that
    value go on to the next column, and only rows that agree in all of them are
    written and told apart by number. All others are compared with the cuts where
    they are read, so ``df`` must give the same rows whenever it is read."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    key, cols = key or df.columns, df.columns
    if not shuffle and order_by is None:
        raise ValueError("order_by is required when shuffle=False")
    first = hash_long(key, seed) if shuffle else _sortable(df, order_by)
    order = [first, *[_sortable(df, k) for k in key]]
    names, down = [f"{_ORDER}{i}" for i in range(len(order))], not shuffle
    strat = F.coalesce(col(stratify).cast("string"), F.lit("\u0000")) if stratify else F.lit("")
    work = df.select("*", strat.alias(_STRATUM), *[c.alias(n) for c, n in zip(order, names)])
    classes = stored(work.groupBy(_STRATUM).count(), "strata")
    n = classes.agg(F.sum("count")).first()[0]
    if not n:
        return df.withColumn("split", F.lit("train"))
    n_test = math.ceil(test_size * n)
    open_ = _allocate(classes, n_test, n) if stratify else classes.select(_STRATUM, F.lit(n_test).cast("long").alias("want"))

    table, tied, depth = None, work, 0
    for level, name in enumerate(names):
        got = stored(cuts(tied, _STRATUM, name, down, open_), "cuts")
        one = got.select(_STRATUM, F.col(name).alias(f"__c{level}"), F.lit(True).alias(f"__p{level}"))
        table = one if table is None else table.join(one, _STRATUM, "left")
        depth = level + 1
        more = got.where("eq > want - lt")
        open_ = stored(more.select(_STRATUM, (F.col("want") - F.col("lt")).alias("want")), "cuts")
        if open_.isEmpty():
            break
        at = small(more.select(_STRATUM, F.col(name).alias("__cut")))
        tied = tied.join(at, _STRATUM).where(F.col(name).eqNullSafe(F.col("__cut"))).drop("__cut")
    table = table.join(open_.select(_STRATUM, F.col("want").alias("__left")), _STRATUM, "left")

    test, same = F.lit(True), F.lit(True)
    for level in reversed(range(depth)):
        x, cut, there = F.col(names[level]), F.col(f"__c{level}"), F.col(f"__p{level}")
        before = F.coalesce(x > cut if down else x < cut, F.lit(False)) | (x.isNotNull() & cut.isNull())
        test = F.when(there, before | (x.eqNullSafe(cut) & test)).otherwise(True)
        same = F.when(there, x.eqNullSafe(cut)).otherwise(True) & same
    state = (F.when(F.col("__p0").isNull(), "train").when(F.col("__left").isNotNull() & same, "tied")
             .when(test, "test").otherwise("train"))
    joined = work.join(small(table), _STRATUM, "left").withColumn("split", state)
    out = joined.select(*[col(c) for c in cols], "split")
    if open_.isEmpty():
        return out
    rows = stored(joined.where("split = 'tied'").select(*[col(c) for c in cols], _STRATUM, "__left"), "tied")
    numbered = positions(rows.select(_STRATUM, F.struct(*[col(c) for c in cols]).alias("__row"), "__left", F.lit(1).cast("long").alias("__one"),
                                     F.monotonically_increasing_id().alias("__id")), [F.col(_STRATUM), F.col("__id")], "__one")
    start = numbered.groupBy(_STRATUM).agg(F.min("__before").alias("__start"))
    told = (numbered.join(small(start), _STRATUM)
            .select("__row.*", F.when(F.col("__before") - F.col("__start") < F.col("__left"), "test").otherwise("train").alias("split")))
    return out.where("split != 'tied'").unionByName(told)


def split_summary(split_df: DataFrame) -> DataFrame:
    """(split, rows, ratio)."""
    total = split_df.count()
    return (split_df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("ratio", rnd(F.col("rows") / F.lit(float(total or 1)), 4)))
