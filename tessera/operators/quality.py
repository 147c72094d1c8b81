"""Data-quality report: missing values, duplicates, outliers, cardinality
(Q1-Q9)."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import pround, rnd, col, dtype_name, is_missing, num, numeric_cols
from tessera.functions.frames import explode_structs, multipass
from tessera.functions.quantiles import quantile_values


def _row_missing(df: DataFrame):
    return sum((F.when(is_missing(df, c), 1).otherwise(0) for c in df.columns), F.lit(0))


def quality_summary(df: DataFrame) -> DataFrame:
    """One row: rows, cols, total_missing, missing_pct, duplicate_rows,
    complete_rows.  Missing counts come from one plain aggregate without a
    shuffle of rows; only the duplicate count groups whole rows (equal ones
    merge in the map tasks)."""
    ncols = len(df.columns)
    missing = _row_missing(df)
    plain = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("total_missing"),
                   F.count_if(missing == 0).alias("complete_rows")).first()
    rows = F.lit(plain["rows"]).cast("long")
    return duplicate_count(df).select(
        rows.alias("rows"), F.lit(ncols).alias("cols"), F.lit(plain["total_missing"]).cast("long").alias("total_missing"),
        rnd(F.try_divide(F.lit(plain["total_missing"] * 100.0), rows * ncols), 2).alias("missing_pct"),
        "duplicate_rows", F.lit(plain["complete_rows"]).cast("long").alias("complete_rows"))


def missing_by_column(df: DataFrame, n: int | None = None) -> DataFrame:
    """(column, missing, missing_pct, dtype) for columns with missing
    values, most missing first."""
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(is_missing(df, c)).alias(f"__m{i}") for i, c in enumerate(df.columns)])
    out = explode_structs(row, [F.struct(
        F.lit(i).alias("__pos"), F.lit(f.name).alias("column"), F.col(f"__m{i}").alias("missing"),
        rnd(F.try_divide(F.col(f"__m{i}") * 100.0, F.col("__rows")), 2).alias("missing_pct"),
        F.lit(dtype_name(f.dataType)).alias("dtype")) for i, f in enumerate(df.schema.fields)])
    out = out.where(F.col("missing") > 0).orderBy(F.col("missing").desc(), "__pos")
    if n:
        out = out.limit(n)
    return out.drop("__pos")


def missing_matrix(df: DataFrame, order_by: list[str], n: int = 100) -> DataFrame:
    """First ``n`` rows by ``order_by``: the order key plus a 0/1 flag per
    column that has missing values."""
    miss = [r["column"] for r in missing_by_column(df).collect()]
    keep = [c for c in df.columns if c in miss]
    return (df.orderBy(*[col(c) for c in order_by]).limit(n)
            .select(*[col(c) for c in order_by],
                    *[is_missing(df, c).cast("int").alias(f"{c}_missing") for c in keep]))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: duplicate_rows = rows beyond the first copy (NULLs equal)."""
    g = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__cnt"))
    return g.agg(F.coalesce(F.sum(F.col("__cnt") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_rows(df: DataFrame, n: int | None = 30) -> DataFrame:
    """Every copy of each duplicated row (``keep=False``), ordered by all
    columns.  The first ``n`` are rebuilt from (row, count) groups, at most n
    copies of each; without ``n`` the rows themselves are kept by a semi join."""
    cols = df.columns
    g = (df.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("__cnt"))
         .where(F.col("__cnt") > 1))
    order = [col(c).asc_nulls_first() for c in cols]
    if not n:
        twice = g.select(*[col(c).alias(f"__{i}") for i, c in enumerate(cols)])
        same = functools.reduce(operator.and_, [df[f"`{c}`"].eqNullSafe(twice[f"__{i}"]) for i, c in enumerate(cols)])
        return df.join(twice, same, "left_semi").orderBy(*order)
    few = g.orderBy(*order).limit(n)
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("__cnt"), F.lit(n)).cast("int")))
    return (few.select(*[col(c) for c in cols], copies.alias("__copy")).orderBy(*order, "__copy").limit(n).drop("__copy"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows over all columns (the survivor of identical copies is
    unambiguous)."""
    return df.dropDuplicates()


def iqr_outliers(df: DataFrame, cols: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """(column, q1, q3, iqr, outliers, outlier_pct): Tukey fences with
    exact quartiles, strict comparisons, % of non-null values; sorted by
    outlier_pct descending."""
    cols = cols or numeric_cols(df)
    spark = df.sparkSession
    with multipass(df, cols) as work:
        qv, ex = quantile_values(work, cols, [0.25, 0.75])
        q, row = qv[()], ex[()]
        aggs = []
        for i, c in enumerate(cols):
            q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
            if q1 is None:
                aggs.append(F.lit(0).alias(f"o{i}"))
                continue
            iqr = q3 - q1
            x = num(work, c)
            aggs.append(F.count_if((x < F.lit(q1 - k * iqr)) | (x > F.lit(q3 + k * iqr))).alias(f"o{i}"))
        cnt = work.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(cols):
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        n = row[f"__n_{i}"]
        o = int(cnt[f"o{i}"])
        out.append((i, c, None if q1 is None else pround(q1, 3), None if q3 is None else pround(q3, 3),
                    None if q1 is None else pround(q3 - q1, 3), o,
                    pround(o / n * 100, 2) if n else None))
    res = spark.createDataFrame(out, "__pos int, column string, q1 double, q3 double, iqr double, "
                                     "outliers long, outlier_pct double")
    return res.orderBy(F.col("outlier_pct").desc_nulls_last(), "__pos").drop("__pos")


def top_outlier_columns(df: DataFrame, n: int = 6, cols: list[str] | None = None) -> DataFrame:
    """The ``n`` columns with the highest outlier share (outliers > 0)."""
    return iqr_outliers(df, cols).where(F.col("outliers") > 0).limit(n)


def cardinality(df: DataFrame, threshold: float = 50.0, approx_distinct: bool = False) -> DataFrame:
    """(column, unique, cardinality_pct, dtype, high): distinct values and
    their share of rows (r2); high when above ``threshold`` %."""
    from tessera.operators.profile import profile
    p = profile(df, approx_distinct)
    rows = F.col("non_null") + F.col("nulls")
    pct = rnd(F.try_divide(F.col("n_distinct") * 100.0, rows), 2)
    return (p.select("position", "column", F.col("n_distinct").alias("unique"),
                     pct.alias("cardinality_pct"), "dtype")
            .withColumn("high", F.col("cardinality_pct") > threshold)
            .orderBy(F.col("unique").desc(), "position").drop("position"))
