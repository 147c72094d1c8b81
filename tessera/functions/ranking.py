"""Places in a total order of any columns, and what is read off them.

``positions`` deals rows into ranges of the real columns (of whatever orderable
type), sorts each range, counts it, and adds the counts of the ranges before:
one number a range comes to the driver. Rows carry a weight, so equal ones are
merged before, and a value that a third of all rows share is one row here.

``cuts`` finds, per class, the value at a place; ``grouped_quantiles`` finds exact
quantiles per group from a table of brackets (one row a group) that stays
distributed and is joined to the rows. Neither has a limit on groups."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col, num
from tessera.functions.frames import stored

#: Rows of a table of brackets or cuts that may be broadcast (some tens of bytes a number).
BROADCAST_ROWS = 50_000
#: Accuracy of the sketch that brackets a rank, and how far from the rank (as a
#: share of the group) a bracket reaches.
ACCURACY, REACH = 2000, 0.003


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is short enough, counted or given."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def equal_on(a: DataFrame, b: DataFrame, names: list[str], prefix: str = "") -> Column:
    """Null-safe equality of columns ``names`` of ``a`` and ``prefix + name`` of ``b``."""
    return functools.reduce(operator.and_, [a[f"`{n}`"].eqNullSafe(b[f"`{prefix}{n}`"]) for n in names])


def positions(df: DataFrame, order: list[Column], weight: str) -> DataFrame:
    """``df`` plus ``__before``: the weight of all rows before each in ``order``."""
    schema = T.StructType([*df.schema.fields, T.StructField("__range", T.IntegerType()), T.StructField("__before", T.LongType())])

    def number(batches):
        at, before = TaskContext.get().partitionId(), 0
        for b in batches:
            total = np.cumsum(b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)) + before
            here = np.concatenate([[before], total[:-1]])
            before = int(total[-1]) if len(total) else before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(total), at, np.int32)), pa.array(here[:len(total)])],
                                             names=[*b.schema.names, "__range", "__before"])

    done = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "positions")
    sums, total = [], 0
    for r in sorted(done.groupBy("__range").agg(F.sum(weight).alias("n")).collect()):
        sums.append((r["__range"], total))
        total += r["n"]
    base = df.sparkSession.createDataFrame(sums, "__range int, __base long")  # a row a range
    return (done.join(F.broadcast(base), "__range").withColumn("__before", F.col("__before") + F.col("__base"))
            .drop("__range", "__base"))


#: Values that one row of a grid is paired with at a time.
GRID = 1000


def grid(left: DataFrame, right: DataFrame, size: int | None = None) -> DataFrame:
    """All pairs of a value of ``left`` and one of ``right`` (frames of one column of
    distinct values): up to ``size`` right values are exploded as literals; more are dealt into
    lists of ``size``, to which the left values are joined list by list."""
    size = size or GRID
    a, b = left.columns[0], right.columns[0]
    values = [r[0] for r in right.limit(size + 1).collect()]
    if not values:
        return left.where("false").withColumn(b, F.lit(None).cast(right.schema[b].dataType))
    if len(values) <= size:
        return left.select(col(a), F.explode(F.array(*[F.lit(v) for v in values])).alias(b))
    at = positions(right.select(col(b).alias("__v"), F.lit(1).cast("long").alias("__w")), [F.col("__v")], "__w")
    lists = at.groupBy(F.floor(F.col("__before") / size).alias("__list")).agg(F.collect_list("__v").alias("__vs"))
    turns = left.withColumn("__list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((right.count() - 1) // size).cast("long"))))
    return turns.join(lists, "__list").select(col(a), F.explode("__vs").alias(b))


def cuts(df: DataFrame, by: str, value: str, descending: bool, wanted: DataFrame) -> DataFrame:
    """Per class of ``wanted`` (by, want): the ``value`` that the want-th row has
    (first ascending or descending, NULL last), rows before it (lt) and with it (eq)."""
    order = col(value).desc_nulls_last() if descending else col(value).asc_nulls_last()
    counted = df.groupBy(col(by), col(value)).agg(F.count(F.lit(1)).alias("__n"))
    at = positions(counted, [col(by), order], "__n")
    start = at.groupBy(col(by)).agg(F.min("__before").alias("__start"))
    marks = wanted.join(start, by).select(col(by), "want", "__start")
    here = at.join(small(marks), by).withColumn("lt", F.col("__before") - F.col("__start"))
    return here.where("lt < want and want <= lt + __n").select(col(by), col(value), "want", "lt", F.col("__n").alias("eq"))


def keyed(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose group key is complete (a NaN key is a missing one)."""
    for b in by:
        df = df.where(col(b).isNotNull())
        if isinstance(df.schema[b].dataType, (T.FloatType, T.DoubleType)):
            df = df.where(~F.isnan(col(b)))
    return df


def _settle(data: DataFrame, marks: DataFrame, keys: list[str], n_cols: int, probs: list[float]) -> DataFrame:
    """(keys, slot, k, v): values at the wanted ranks that lie in the brackets
    ``marks`` (keys, n<i>, lo<i>_<j>, hi<i>_<j>; a NULL end is open)."""
    slots = [(i, j) for i in range(n_cols) for j in range(len(probs))]
    joined = data.join(small(marks), keys)

    def v(i):
        return F.col(f"__v{i}")

    def lo(i, j):
        return F.col(f"lo{i}_{j}")

    below = joined.groupBy(*keys).agg(*[F.count_if(v(i) < lo(i, j)).alias(f"b{i}_{j}") for i, j in slots])
    below = below.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(None).cast("double").alias("v"),
                                                             F.col(f"b{i}_{j}").alias("n")) for s, (i, j) in enumerate(slots)])).alias("s"))
    inside = [F.when(v(i).isNotNull() & (lo(i, j).isNull() | (v(i) >= lo(i, j)))
                     & (F.col(f"hi{i}_{j}").isNull() | (v(i) <= F.col(f"hi{i}_{j}"))),
                     F.struct(F.lit(s).alias("slot"), (v(i) + 0.0).alias("v"))) for s, (i, j) in enumerate(slots)]
    band = (joined.select(*keys, F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("s"))
            .select(*keys, "s.slot", "s.v").groupBy(*keys, "slot", "v").agg(F.count(F.lit(1)).alias("n")))
    at = positions(below.select(*keys, "s.slot", "s.v", "s.n").unionByName(band),
                   [*[F.col(k) for k in keys], F.col("slot"), F.col("v").asc_nulls_first()], "n")
    # the row of what lies below is the first of its group and slot
    n_of = F.element_at(F.array(*[F.col(f"n{i}") for i, _ in slots]), F.col("slot") + 1)
    p_of = F.element_at(F.array(*[F.lit(float(probs[j])) for _, j in slots]), F.col("slot") + 1)
    first = F.floor((F.col("n_all") - 1) * F.col("p")).cast("long")
    starts = (at.where(F.col("v").isNull()).select(*keys, "slot", F.col("__before").alias("start")).join(marks, keys)
              .select(*keys, "slot", "start", n_of.alias("n_all"), p_of.alias("p")).where("n_all > 0")
              .select(*keys, "slot", "start", F.explode(F.array_distinct(F.array(
                  first, F.least(first + 1, F.col("n_all") - 1)))).alias("k")))
    rank = F.col("__before") - F.col("start")
    return (at.where(F.col("v").isNotNull()).join(starts, [*keys, "slot"])
            .where((rank <= F.col("k")) & (F.col("k") < rank + F.col("n"))).select(*keys, "slot", "k", "v"))


def grouped_quantiles(df: DataFrame, by: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group: ``by``, then per column i
    ``n<i>`` (values that are not missing) and per quantile j ``q<i>_<j>``; rows
    with a missing key are dropped.

    A sketch per group brackets each rank, values inside a bracket are counted
    and ranked over all groups at once. Where a bracket misses its rank, the
    group's whole range is taken; so two rounds settle every group."""
    rows = keyed(df, by)
    keys = [f"__k{i}" for i in range(len(by))]
    data = rows.select(*[col(b).alias(k) for b, k in zip(by, keys)], *[num(df, c).alias(f"__v{i}") for i, c in enumerate(cols)])
    probes = F.array(*[F.lit(min(max(p + d, 0.0), 1.0)) for p in probs for d in (-REACH, REACH)])
    first = data.groupBy(*keys).agg(
        *[F.count(f"__v{i}").alias(f"n{i}") for i in range(len(cols))],
        *[F.percentile_approx(f"__v{i}", probes, F.lit(ACCURACY)).alias(f"s{i}") for i in range(len(cols))])
    ends = [F.get(f"s{i}", F.lit(2 * j + e)).alias(f"{name}{i}_{j}") for i in range(len(cols)) for j in range(len(probs))
            for e, name in ((0, "lo"), (1, "hi"))]
    marks = stored(first.select(*keys, *[f"n{i}" for i in range(len(cols))], *ends), "brackets")
    found = stored(_settle(data, marks, keys, len(cols), probs), "quantiles")
    asked = marks.select(*keys, *[f"n{i}" for i in range(len(cols))])
    wide = _wide(asked, found, keys, len(cols), probs)
    missed = functools.reduce(operator.or_, [F.col(f"q{i}_{j}").isNull() & (F.col(f"n{i}") > 0)
                                             for i in range(len(cols)) for j in range(len(probs))])
    again = wide.where(missed).select(*keys)
    if not again.isEmpty():
        again = stored(again, "brackets")
        open_ = marks.join(again, keys).select(*keys, *[f"n{i}" for i in range(len(cols))],
                                               *[F.lit(None).cast("double").alias(f"{e}{i}_{j}") for e in ("lo", "hi")
                                                 for i in range(len(cols)) for j in range(len(probs))])
        more = stored(_settle(data, open_, keys, len(cols), probs), "quantiles")
        found = found.join(again, keys, "left_anti").unionByName(more)
        wide = _wide(asked, found, keys, len(cols), probs)
    return wide.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *[c for c in wide.columns if c not in keys])


def _wide(asked: DataFrame, found: DataFrame, keys: list[str], n_cols: int, probs: list[float]) -> DataFrame:
    """Interpolated: the values at the ranks below and above n * p."""
    values = []
    for i in range(n_cols):
        for j in range(len(probs)):
            of = F.col("slot") == i * len(probs) + j
            values += [F.min_by(F.when(of, F.col("v")), F.when(of, F.col("k"))).alias(f"a{i}_{j}"),
                       F.max_by(F.when(of, F.col("v")), F.when(of, F.col("k"))).alias(f"b{i}_{j}"),
                       F.count_if(of).alias(f"c{i}_{j}")]
    got = asked.join(found.groupBy(*keys).agg(*values), keys, "left")
    out = []
    for i in range(n_cols):
        out.append(F.col(f"n{i}"))
        for j, p in enumerate(probs):
            h = (F.col(f"n{i}") - 1) * F.lit(float(p))
            w, a, b = h - F.floor(h), F.col(f"a{i}_{j}"), F.col(f"b{i}_{j}")
            both = F.col(f"c{i}_{j}") >= F.when(F.floor(h) + 1 <= F.col(f"n{i}") - 1, 2).otherwise(1)
            out.append(F.when(both, F.when((w == 0) | (a == b), a).otherwise(a + w * (b - a))).alias(f"q{i}_{j}"))
    return got.select(*keys, *out)
