"""Dataset profile, column selection and target detection."""

from __future__ import annotations

import functools
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import (pround, rnd, CATEGORICAL_TYPES, NUMERIC_TYPES, categorical_cols, col,
                                       dtype_name, find_col, find_features, is_missing,
                                       numeric_cols)
from tessera.functions.frames import explode_structs

# Target-column keywords, in match order.
TARGET_KEYWORDS = [
    "weather", "type", "condition", "label", "class", "category",
    "status", "description", "summary", "forecast", "pattern", "season",
]

# Bytes per value of fixed-width types (data-size estimate).
_FIXED_WIDTH = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
    T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8,
    T.TimestampNTZType: 8, T.DecimalType: 16,
}


def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(position, n_distinct) of each column's values, NULL and NaN left out.

    Values go into rows (position, value), one scan for whole numbers, one for
    floating point and one for the rest; equal ones merge in the map tasks, and
    only (position, value) is shuffled."""
    cols = cols or df.columns
    kinds: dict[str, list] = {}
    for c in cols:
        t = df.schema[c].dataType
        kind = ("bigint" if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else
                "double" if isinstance(t, (T.FloatType, T.DoubleType)) else "string")
        value = F.hex(col(c)) if isinstance(t, T.BinaryType) else col(c).cast(kind)
        value = F.when(~is_missing(df, c), value + F.lit(0.0) if kind == "double" else value)  # -0.0 is 0.0
        kinds.setdefault(kind, []).append(F.struct(F.lit(df.columns.index(c)).alias("position"), value.alias("v")))
    parts = [df.select(F.inline(F.array(*items))).where(F.col("v").isNotNull()).distinct()
             .groupBy("position").agg(F.count(F.lit(1)).alias("n_distinct")) for items in kinds.values()]
    return functools.reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """One row per column: (position, column, dtype, non_null, nulls,
    null_pct, n_distinct); distinct counts ignore NULL/NaN.
    ``approx_distinct`` swaps the exact distinct counts for HyperLogLog++
    sketches in the same pass as the null counts."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(~is_missing(df, c)).alias(f"__nn{i}"))
        if approx_distinct:
            aggs.append(F.approx_count_distinct(F.when(~is_missing(df, c), col(c))).alias(f"__nd{i}"))
    row = df.agg(*aggs)
    structs = []
    for i, f in enumerate(df.schema.fields):
        nn = F.col(f"__nn{i}")
        nulls = F.col("__rows") - nn
        structs.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(dtype_name(f.dataType)).alias("dtype"),
            nn.alias("non_null"), nulls.alias("nulls"),
            rnd(F.try_divide(nulls * 100.0, F.col("__rows")), 2).alias("null_pct"),
            (F.col(f"__nd{i}") if approx_distinct else F.lit(0).cast("long")).alias("n_distinct")))
    tall = explode_structs(row, structs)
    if approx_distinct or not df.columns:
        return tall
    exact = distinct_counts(df).select("position", F.col("n_distinct").alias("__nd"))
    return (tall.join(F.broadcast(exact), "position", "left")  # at most a row a column
            .select("position", "column", "dtype", "non_null", "nulls", "null_pct",
                    F.coalesce("__nd", "n_distinct").alias("n_distinct")))


def sample_values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, sample_value): a deterministic non-null example per column
    (the smallest value, as text)."""
    cols = cols or df.columns
    row = df.agg(*[F.min(F.when(~is_missing(df, c), col(c))).cast("string").alias(f"__s{i}")
                   for i, c in enumerate(cols)])
    return explode_structs(row, [F.struct(F.lit(c).alias("column"), F.col(f"__s{i}").alias("sample_value"))
                                 for i, c in enumerate(cols)])


def dtype_counts(df: DataFrame) -> DataFrame:
    """(dtype, n_columns) from the schema (no data pass)."""
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[dtype_name(f.dataType)] = counts.get(dtype_name(f.dataType), 0) + 1
    schema = "dtype string, n_columns long"
    return df.sparkSession.createDataFrame(sorted(counts.items()), schema)


def column_bytes(df: DataFrame, n: int | None = 20) -> DataFrame:
    """(column, bytes, kb) largest first: fixed width x rows for fixed-width
    types, total UTF-8 length for strings, total length for binary."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    exprs = []
    for i, f in enumerate(df.schema.fields):
        width = next((w for t, w in _FIXED_WIDTH.items() if isinstance(f.dataType, t)), None)
        if width is not None:
            exprs.append((f.name, F.col("__rows") * F.lit(width)))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            aggs.append(F.coalesce(F.sum(F.octet_length(col(f.name))), F.lit(0)).alias(f"__b{i}"))
            exprs.append((f.name, F.col(f"__b{i}")))
        else:
            aggs.append(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(col(f.name))))), F.lit(0))
                        .alias(f"__b{i}"))
            exprs.append((f.name, F.col(f"__b{i}")))
    row = df.agg(*aggs)
    out = explode_structs(row, [F.struct(F.lit(c).alias("column"), e.cast("long").alias("bytes"))
                                for c, e in exprs])
    out = out.withColumn("kb", rnd(F.col("bytes") / 1024.0, 2))
    out = out.orderBy(F.col("bytes").desc(), F.col("column"))
    return out.limit(n) if n else out


def distinct_upto(df: DataFrame, cols: list[str], cap: int) -> dict[str, int]:
    """Exact distinct count of each column, but only where it is <= ``cap``
    (others map to ``cap + 1``).  A HyperLogLog pass screens out clearly
    high-cardinality columns so only small exact distincts are shuffled."""
    if not cols:
        return {}
    approx = df.agg(*[F.approx_count_distinct(F.when(~is_missing(df, c), col(c)), 0.02).alias(c)
                      for c in cols]).collect()[0]
    small = [c for c in cols if approx[c] <= 2 * cap + 10]
    out = {c: cap + 1 for c in cols}
    if small:
        exact = df.agg(*[F.count_distinct(F.when(~is_missing(df, c), col(c))).alias(c)
                         for c in small]).collect()[0]
        out.update({c: min(exact[c], cap + 1) for c in small})
    return out


def detect_target(df: DataFrame, keywords: list[str] | None = None) -> str | None:
    """Class column: keywords in order x columns in order, accepting a
    string column at any cardinality or any column with <= 30 distinct
    values; else the first categorical column with 2..20 distinct values."""
    keywords = keywords or TARGET_KEYWORDS
    cands = []
    for kw in keywords:
        for c in df.columns:
            if kw in c.lower() and c not in cands:
                cands.append(c)
    need = [c for c in cands if not isinstance(df.schema[c].dataType, T.StringType)]
    need += [c for c in categorical_cols(df) if c not in need]
    nd = distinct_upto(df, need, 30)
    for kw in keywords:
        for c in df.columns:
            if kw in c.lower():
                if isinstance(df.schema[c].dataType, T.StringType) or nd.get(c, 31) <= 30:
                    return c
    for c in categorical_cols(df):
        if 2 <= nd.get(c, 31) <= 20:
            return c
    return None


def target_summary(df: DataFrame, target: str | None = None) -> DataFrame:
    """(target, n_classes) for the detected (or given) target column."""
    target = target or detect_target(df)
    spark = df.sparkSession
    if target is None:
        return spark.createDataFrame([], "target string, n_classes long")
    return df.agg(F.lit(target).alias("target"),
                  F.count_distinct(col(target)).alias("n_classes"))


def class_counts(df: DataFrame, target: str, n: int | None = 15) -> DataFrame:
    """(target value, count), most frequent first; NULL excluded."""
    out = (df.where(col(target).isNotNull()).groupBy(col(target)).count()
           .orderBy(F.col("count").desc(), col(target)))
    return out.limit(n) if n else out


def class_values(df: DataFrame, target: str, n: int = 10) -> DataFrame:
    """First ``n`` distinct values (NULL included), in value order."""
    return df.select(col(target)).distinct().orderBy(col(target).asc_nulls_last()).limit(n)


__all__ = ["profile", "sample_values", "dtype_counts", "column_bytes", "detect_target",
           "target_summary", "class_counts", "class_values", "numeric_cols", "categorical_cols",
           "find_col", "find_features", "distinct_upto", "TARGET_KEYWORDS",
           "NUMERIC_TYPES", "CATEGORICAL_TYPES"]
