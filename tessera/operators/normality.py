"""Normality of each column by its moments.

The Jarque-Bera statistic over all rows, ``n / 6 * (g1^2 + g2^2 / 4)`` with the
population skewness g1 and excess kurtosis g2; its p-value is that of a
chi-square with two degrees of freedom, ``exp(-JB / 2)``: one pass of plain
aggregates. Beside it the order-statistic test, Shapiro-Francia, over all rows,
from distributed ranks; it takes the place of Shapiro-Wilk, whose weights are only
tabulated for small samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import num, numeric_cols, rnd
from tessera.functions.frames import explode_structs
from tessera.functions.ranking import positions


def normality(df: DataFrame, cols: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """(column, n, jb, p_value, normal) for columns with more than 3 non-null
    values; normal when p > alpha. jb rounded to 4, p to 6; both NULL, and
    normal false, for a constant column."""
    cols = cols or numeric_cols(df)
    aggs = []
    for i, c in enumerate(cols):
        x = num(df, c)
        aggs += [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"s{i}"), F.kurtosis(x).alias(f"k{i}")]
    row = df.agg(*aggs)
    out = explode_structs(row, [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"),
                                         F.col(f"k{i}").alias("k")) for i, c in enumerate(cols)]).where("n > 3")
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    p = F.exp(-jb / 2)
    return out.select("column", "n", rnd(jb, 4).alias("jb"), rnd(p, 6).alias("p_value"),
                      F.coalesce(p > alpha, F.lit(False)).alias("normal"))


#: Wichura's algorithm AS 241 (1988) for the normal distribution's
#: inverse, numerators and denominators of its three ranges, lowest power first.
_CENTRE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
            4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
           [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
            2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
_MIDDLE = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
            1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
           [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
            1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
_TAIL = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
          2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
         [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])

#: Ranks whose normal scores are added up at a time.
RANKS = 1 << 20


def normal_scores(p: np.ndarray) -> np.ndarray:
    """The normal distribution's inverse at p in (0, 1)."""
    def ratio(of, x):
        return np.polyval(of[0][::-1], x) / np.polyval(of[1][::-1], x)
    q = p - 0.5
    out = q * ratio(_CENTRE, 0.180625 - q * q)
    far = np.flatnonzero(np.abs(q) > 0.425)
    r = np.sqrt(-np.log(np.minimum(p[far], 1 - p[far])))
    out[far] = np.sign(q[far]) * np.where(r <= 5, ratio(_MIDDLE, r - 1.6), ratio(_TAIL, r - 5.0))
    return out


def _add_scores(batches):
    """From rows (c, x, n, first, last), sums by column c: of x times the scores of these
    ranks, and of the scores' squares; up to RANKS scores, or one row's, at a time."""
    for b in batches:
        c, x, n, first, last = (b.column(b.schema.names.index(k)).to_numpy(zero_copy_only=False) for k in ("c", "x", "n", "first", "last"))
        count = last - first + 1
        ends, a = np.cumsum(count), 0
        while a < len(c):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + RANKS, side="right")))
            k, at = count[a:z], ends[a:z] - count[a:z] - (ends[a - 1] if a else 0)
            ranks = np.arange(int(k.sum())) + np.repeat(first[a:z] - at, k)
            m = normal_scores((ranks - 0.375) / (np.repeat(n[a:z], k) + 0.25))
            on, of = np.unique(c[a:z], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(np.bincount(of, x[a:z] * np.add.reduceat(m, at))),
                                              pa.array(np.bincount(of, np.add.reduceat(m * m, at)))], names=["c", "xm", "mm"])
            a = z


def shapiro_francia(df: DataFrame, cols: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """(column, n, w, z, p_value, normal): the Shapiro-Francia statistic W', the
    squared correlation of the sorted values with their normal scores (Blom's, each
    of equal values its own), over all rows; z and p by Royston's (1993) fit, made
    for 5 to 5000 values and continued beyond. Columns with fewer than 5 values are
    left out; a constant column has NULLs and is not normal.

    Values are counted, and ranked by ``positions``; a value on many rows is dealt
    out in blocks of ranks."""
    cols = cols or numeric_cols(df)
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), (num(df, c) + 0.0).alias("x")) for i, c in enumerate(cols)])).alias("s"))
    counted = tall.select("s.c", "s.x").where("x IS NOT NULL").groupBy("c", "x").agg(F.count(F.lit(1)).alias("__n"))
    at = positions(counted, [F.col("c"), F.col("x")], "__n")
    start = at.groupBy("c").agg(F.min("__before").alias("start"), F.sum("__n").alias("n"))
    row = df.agg(*[f(num(df, c)).alias(f"{name}{i}") for i, c in enumerate(cols) for name, f in (("m", F.avg), ("v", F.var_pop))]).first()
    # one row a column
    known = df.sparkSession.createDataFrame([(i, c, row[f"m{i}"], row[f"v{i}"]) for i, c in enumerate(cols)],
                                            "c int, column string, mean double, var double")
    first = F.col("__before") - F.col("start")
    ranks = (at.join(F.broadcast(start.join(known, "c")), "c").where("n >= 5")
             .select("c", (F.col("x") - F.col("mean")).alias("x"), "n", first.alias("from"), (first + F.col("__n")).alias("to"))
             .withColumn("a", F.explode(F.sequence(F.col("from"), F.col("to") - 1, F.lit(RANKS).cast("long"))))
             .select("c", "x", "n", (F.col("a") + 1).alias("first"), F.least(F.col("a") + RANKS, "to").alias("last")))
    # a value's blocks leave the task that counted it
    hot = ranks.repartition("c", "first") if at.where(F.col("__n") > RANKS).limit(1).count() else ranks
    sums = hot.mapInArrow(_add_scores, "c int, xm double, mm double").groupBy("c").agg(F.sum("xm").alias("xm"), F.sum("mm").alias("mm"))
    ss = F.col("var") * F.col("n")
    w = F.when(F.col("var") > 0, F.col("xm") * F.col("xm") / (ss * F.col("mm")))
    u, v = F.ln("n"), F.ln(F.ln("n"))
    z = (F.ln(1 - F.col("w")) - (F.lit(1.0521) * (v - u) - 1.2725)) / (1.0308 - 0.26758 * (v + 2 / u))
    out = sums.join(start, "c").join(known, "c").withColumn("w", w).withColumn("z", z)

    @F.pandas_udf("double")
    def upper(x: pd.Series) -> pd.Series:  # a row a column
        return x.map(lambda t: None if pd.isna(t) else 0.5 * math.erfc(t / math.sqrt(2)))

    out = out.withColumn("p", upper("z"))
    return out.select("column", "n", rnd("w", 6).alias("w"), rnd("z", 4).alias("z"), rnd("p", 6).alias("p_value"),
                      F.coalesce(F.col("p") > alpha, F.lit(False)).alias("normal"))
