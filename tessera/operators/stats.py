"""Descriptive, grouped and correlation statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import pround, rnd, col, num, numeric_cols
from tessera.functions.frames import explode_structs, multipass, stored
from tessera.functions.linalg import column_facts, masked_products
from tessera.functions.moments import adj_kurt, adj_skew, pearson
from tessera.functions.quantiles import BAND_LIMIT, quantile_values
from tessera.functions.ranking import grid, grouped_quantiles, keyed, small

_DESCRIBE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType(), False),
    *[T.StructField(n, T.DoubleType(), True) for n in
      ("count", "mean", "std", "min", "q1", "median", "q3", "max",
       "variance", "skewness", "kurtosis", "mode")],
])


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mode): most frequent non-null value, the smallest on ties.
    Value counts are a distributed (column, value) aggregation with
    map-side combine, so a hot value never piles up in one buffer."""
    tall = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ci"), num(df, c).alias("v")) for i, c in enumerate(cols)
    ])).alias("s")).select("s.ci", "s.v").where(F.col("v").isNotNull())
    counts = tall.groupBy("ci", "v").count()
    best = counts.groupBy("ci").agg(F.max(F.struct(F.col("count").alias("c"), (-F.col("v")).alias("nv"))).alias("b"))
    names = F.array(*[F.lit(c) for c in cols])
    return best.select(F.element_at(names, F.col("ci") + 1).alias("column"),
                       (-F.col("b.nv")).alias("mode"))


def describe(df: DataFrame, cols: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """Tall describe: one row per numeric column with count, mean, sample
    std, min, Q1, median, Q3, max, sample variance, adjusted skewness and
    kurtosis, and mode.  Quartiles are exact (linear interpolation)."""
    cols = cols or numeric_cols(df)
    spark = df.sparkSession
    with multipass(df, cols) as work:
        extra = []
        for i, c in enumerate(cols):
            x = num(work, c)
            extra += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                      F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                      F.var_samp(x).alias(f"var{i}"), adj_skew(x).alias(f"skew{i}"),
                      adj_kurt(x).alias(f"kurt{i}")]
        qv, ex = quantile_values(work, cols, [0.25, 0.5, 0.75], extra_aggs=extra)
        mode_rows = {r["column"]: r["mode"] for r in modes(work, cols).collect()}
    q, row = qv[()], ex[()]
    out = []
    for i, c in enumerate(cols):
        vals = [float(row[f"__n_{i}"]), row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"],
                q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)], row[f"max{i}"], row[f"var{i}"],
                row[f"skew{i}"], row[f"kurt{i}"], mode_rows.get(c)]
        vals = [None if v is None else (pround(float(v), digits) if digits is not None else float(v))
                for v in vals]
        out.append([c] + vals)
    return spark.createDataFrame(out, _DESCRIBE_SCHEMA)


def inspect_column(df: DataFrame, c: str, digits: int = 4) -> DataFrame:
    """Mean, median, std, variance, skewness, kurtosis of one column."""
    return describe(df, [c], digits).select("column", "mean", "median", "std", "variance",
                                             "skewness", "kurtosis")


def skew_ranking(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, skewness, kurtosis) ranked by |skewness| descending."""
    cols = cols or numeric_cols(df)
    row = df.agg(*[adj_skew(num(df, c)).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[adj_kurt(num(df, c)).alias(f"k{i}") for i, c in enumerate(cols)])
    out = explode_structs(row, [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("skewness"),
                                         F.col(f"k{i}").alias("kurtosis"))
                                for i, c in enumerate(cols)])
    return out.orderBy(F.abs("skewness").desc_nulls_last(), "column")


def value_counts(df: DataFrame, c: str, n: int | None = 20) -> DataFrame:
    """(value, count), NULL excluded, most frequent first."""
    out = (df.where(col(c).isNotNull()).groupBy(col(c).alias("value")).count()
           .orderBy(F.col("count").desc(), F.col("value")))
    return out.limit(n) if n else out


def grouped_stats(df: DataFrame, key: str, cols: list[str], digits: int = 3) -> DataFrame:
    """Per key: ``<col>_mean``, ``<col>_std`` (sample), ``<col>_median``
    (exact); rows with a NULL or NaN key dropped.

    Groups of up to BAND_LIMIT rows are aggregated by built-in functions; of the
    larger ones (at most one in BAND_LIMIT rows) the medians are found by
    distributed ranks, so that no buffer holds a hot group."""
    d = keyed(df, [key]).select(col(key), *[num(df, c).alias(f"__x{i}") for i, c in enumerate(cols)])

    def moments(i: int, c: str) -> list[Column]:
        x = F.col(f"__x{i}")
        return [rnd(F.avg(x), digits).alias(f"{c}_mean"), rnd(F.stddev_samp(x), digits).alias(f"{c}_std")]

    names = [n for c in cols for n in (f"{c}_mean", f"{c}_std", f"{c}_median")]
    # one pass; it says which groups are hot, and has all but the medians
    plain = stored(d.groupBy(col(key)).agg(F.count(F.lit(1)).alias("__rows"), *[m for i, c in enumerate(cols) for m in moments(i, c)]), "groups")
    hot = plain.where(F.col("__rows") > BAND_LIMIT).select(col(key))
    n_hot = hot.count()
    few = d if not n_hot else d.join(small(hot, n_hot), key, "left_anti")
    medians = few.groupBy(col(key)).agg(*[rnd(F.percentile(F.col(f"__x{i}"), 0.5), digits).alias(f"{c}_median") for i, c in enumerate(cols)])
    if n_hot:
        q = grouped_quantiles(d.join(small(hot, n_hot), key), [key], [f"__x{i}" for i in range(len(cols))], [0.5])
        medians = medians.unionByName(q.select(col(key), *[rnd(F.col(f"q{i}_0"), digits).alias(f"{c}_median") for i, c in enumerate(cols)]))
    return plain.join(medians, key).select(col(key), *[col(n) for n in names])


def grouped_mean(df: DataFrame, key: str, c: str, grain: str | None = None,
                 digits: int | None = None) -> DataFrame:
    """Mean of ``c`` per key (optionally a date/timestamp truncated to
    ``grain``: year, quarter, month, week, day, hour), sorted by key."""
    if grain in ("year", "quarter", "month", "week", "day"):
        k = F.to_date(F.date_trunc(grain, col(key))).alias(key)
    elif grain:
        k = F.date_trunc(grain, col(key)).alias(key)
    else:
        k = col(key)
    m = F.avg(num(df, c))
    m = rnd(m, digits) if digits is not None else m
    return (df.where(col(key).isNotNull()).groupBy(k).agg(m.alias(f"{c}_mean")).orderBy(key))


def count_by(df: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target, count) for non-null pairs."""
    return (df.where(col(key).isNotNull() & col(target).isNotNull())
            .groupBy(col(key), col(target)).count())


def crosstab(df: DataFrame, a: str, b: str, zeros: bool = True) -> DataFrame:
    """Tall crosstab (a, b, count). ``zeros``: cells that do not occur are rows
    of count 0 as well (levels of a times levels of b); off, only counted cells."""
    d = df.where(col(a).isNotNull() & col(b).isNotNull())
    counts = d.groupBy(col(a), col(b)).count()
    if not zeros:
        return counts
    cells = grid(counts.select(col(a)).distinct(), counts.select(col(b)).distinct())
    return (cells.join(counts, on=[a, b], how="left")
            .select(col(a), col(b), F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def _num_sql(df: DataFrame, name: str) -> str:
    from tessera.functions.quantiles import _num_sql as q
    return q(df, name)


def corr_matrix(df: DataFrame, cols: list[str] | None = None, digits: int | None = None,
                chunk: int = 600) -> DataFrame:
    """Tall Pearson matrix (a, b, r) over all ordered pairs, pairwise
    complete (rows where both values are present).

    One small pass gives each column's count and mean; a second pass sums
    deviations from those means (plain sums, mergeable, numerically stable
    because the shift is the mean).  Columns without NULLs share their
    per-column sums across all pairs; a pair involving a column with NULLs
    gets its own sums over the rows where both are present.  Inputs of more
    than ``chunk`` pairs take both passes as matrix products of Arrow batches."""
    cols = cols or numeric_cols(df)
    if len(cols) * (len(cols) - 1) // 2 > chunk:
        return _wide_corr(df, cols, digits)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    spark = df.sparkSession
    vals: dict = {}
    with multipass(df, cols) as work:
        xs = [num(work, c) for c in cols]
        st = work.agg(F.count(F.lit(1)).alias("n"), *[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)],
                      *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
                      *[(F.min(x) == F.max(x)).alias(f"k{i}") for i, x in enumerate(xs)]).collect()[0]
        n = st["n"]
        full = [st[f"n{i}"] == n for i in range(len(cols))]
        const = [st[f"k{i}"] is not False for i in range(len(cols))]
        dev = [x - F.lit(float(st[f"m{i}"] if st[f"m{i}"] is not None else 0.0)) for i, x in enumerate(xs)]
        one = [F.sum(dev[i]).alias(f"s{i}") for i in range(len(cols))] + \
              [F.sum(dev[i] * dev[i]).alias(f"q{i}") for i in range(len(cols))]
        exprs = []
        for i, j in pairs:
            exprs.append(F.sum(dev[i] * dev[j]).alias(f"p{i}_{j}"))
            if not (full[i] and full[j]):
                both = xs[i].isNotNull() & xs[j].isNotNull()
                di, dj = F.when(both, dev[i]), F.when(both, dev[j])
                exprs += [F.count_if(both).alias(f"n{i}_{j}"), F.sum(di).alias(f"si{i}_{j}"),
                          F.sum(dj).alias(f"sj{i}_{j}"), F.sum(di * di).alias(f"qi{i}_{j}"),
                          F.sum(dj * dj).alias(f"qj{i}_{j}")]
        row = diag = work.agg(*(exprs + one)).collect()[0]
        for i, j in pairs:
            if const[i] or const[j]:
                vals[(i, j)] = None
                continue
            if full[i] and full[j]:
                m, si, sj, qi, qj = n, diag[f"s{i}"], diag[f"s{j}"], diag[f"q{i}"], diag[f"q{j}"]
            else:
                m, si, sj = row[f"n{i}_{j}"], row[f"si{i}_{j}"], row[f"sj{i}_{j}"]
                qi, qj = row[f"qi{i}_{j}"], row[f"qj{i}_{j}"]
            vals[(i, j)] = _pearson(m, si, sj, qi, qj, row[f"p{i}_{j}"])
    out = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                ni, si, qi = st[f"n{i}"], diag[f"s{i}"], diag[f"q{i}"]
                ok = ni >= 2 and not const[i] and qi is not None and qi - si * si / ni > 0
                r = 1.0 if ok else None
            else:
                r = vals[(min(i, j), max(i, j))]
            if r is not None and digits is not None:
                r = pround(r, digits)
            out.append((i, j, a, b, r))
    return spark.createDataFrame(out, "i int, j int, a string, b string, r double")


def _wide_corr(df: DataFrame, cols: list[str], digits: int | None) -> DataFrame:
    """``corr_matrix`` of many columns in two jobs."""
    d = len(cols)
    with multipass(df, cols) as work:
        xs = [num(work, c) for c in cols]
        facts = column_facts(work, xs)
        n, s, q, p = masked_products(work, xs, facts["mean"])
    m = np.maximum(n, 1)
    sxx, syy, sxy = q - s * s / m, q.T - s.T * s.T / m, p - s * s.T / m
    const = ~(facts["hi"] > facts["lo"])
    ok = (n >= 2) & (sxx > 1e-12 * q) & (syy > 1e-12 * q.T) & ~const[:, None] & ~const
    r = np.where(ok, np.clip(sxy / np.sqrt(np.where(ok, sxx * syy, 1.0)), -1.0, 1.0), np.nan)
    r[np.diag_indices(d)] = np.where(np.diag(ok), 1.0, np.nan)
    if digits is not None:
        r = np.where(np.isnan(r), r, np.sign(r) * np.floor(np.abs(r) * 10.0 ** digits + 0.5) / 10.0 ** digits) + 0.0
    i, j = (a.reshape(-1) for a in np.indices((d, d)))
    names = np.array(cols, dtype=object)
    out = pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "a": pa.array(names[i], pa.string()), "b": pa.array(names[j], pa.string()),
                    "r": pa.array(r.reshape(-1), pa.float64(), from_pandas=True)})
    return df.sparkSession.createDataFrame(out, "i int, j int, a string, b string, r double")


def _pearson(m, si, sj, qi, qj, p):
    """r from sums of deviations over the ``m`` complete pairs; NULL for
    fewer than two pairs or a zero variance."""
    if not m or m < 2 or p is None:
        return None
    sxx, syy, sxy = qi - si * si / m, qj - sj * sj / m, p - si * sj / m
    if sxx <= 1e-12 * qi or syy <= 1e-12 * qj:          # constant over the complete pairs
        return None
    return max(-1.0, min(1.0, sxy / (sxx * syy) ** 0.5))


def corr_pairs(df: DataFrame, cols: list[str] | None = None, n: int | None = 10,
               min_abs: float | None = None, digits: int = 4) -> DataFrame:
    """Upper-triangle pairs (feature_a, feature_b, correlation, abs_corr)
    by |r| descending; ``min_abs`` keeps |r| > min_abs."""
    m = corr_matrix(df, cols)
    out = (m.where((F.col("i") < F.col("j")) & F.col("r").isNotNull())
           .select(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"),
                   rnd("r", digits).alias("correlation"),
                   rnd(F.abs("r"), digits).alias("abs_corr"), "i", "j", F.abs("r").alias("__a")))
    if min_abs is not None:
        out = out.where(F.col("__a") > min_abs)
    out = out.orderBy(F.col("__a").desc(), "i", "j")
    if n:
        out = out.limit(n)
    return out.drop("i", "j", "__a")


def high_corr(df: DataFrame, threshold: float = 0.80, cols: list[str] | None = None) -> DataFrame:
    """Pairs with |r| above ``threshold``, r rounded to 3."""
    return corr_pairs(df, cols, n=None, min_abs=threshold, digits=3)


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """(n_classes, max_count, min_count, ratio, level): level is severe
    above 5, moderate above 2, else balanced."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target)).count()
    ratio = F.try_divide(F.max("count").cast("double"), F.min("count"))
    out = counts.agg(F.count(F.lit(1)).alias("n_classes"), F.max("count").alias("max_count"),
                     F.min("count").alias("min_count"), ratio.alias("__r"))
    level = F.when(F.col("__r") > 5, "severe").when(F.col("__r") > 2, "moderate").otherwise("balanced")
    return out.select("n_classes", "max_count", "min_count", rnd("__r", 4).alias("ratio"), level.alias("level"))


def zero_share(df: DataFrame, c: str) -> DataFrame:
    """(column, zero_pct, dry): % exact zeros among non-null values, r1;
    dry when above 60."""
    x = num(df, c)
    pct = rnd(F.try_divide(F.count_if(x == 0) * 100.0, F.count(x)), 1)
    return df.agg(F.lit(c).alias("column"), pct.alias("zero_pct")).withColumn(
        "dry", F.col("zero_pct") > 60)
