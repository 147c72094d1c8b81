"""Schema walks and Column helpers.

Typing rule of the tabular model: numeric = byte..long, float, double,
decimal (booleans are *not* numeric); categorical = string, boolean, date,
timestamp; nested types belong to neither list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
CATEGORICAL_TYPES = (T.StringType, T.VarcharType, T.CharType, T.BooleanType,
                     T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def categorical_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, CATEGORICAL_TYPES)]


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def q(name: str) -> str:
    """Backtick-quote a column name for use inside F.col / expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def num(df: DataFrame, name: str) -> Column:
    """Numeric column as double with NaN mapped to NULL (aggregates then
    skip it, as the tabular model treats NaN as missing)."""
    c = col(name).cast("double")
    dt = df.schema[name].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = F.nanvl(c, F.lit(None).cast("double"))
    return c


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for float columns."""
    c = col(name)
    dt = df.schema[name].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN to NULL in every float/double column (one projection)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.nanvl(col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(col(f.name))
    return df.select(*exprs)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 (never raises under ANSI mode)."""
    return F.try_divide(a, b)


def rnd(c: Column, digits: int) -> Column:
    """Round half away from zero on the value scaled by 10**digits (the
    rounding rule used throughout the library, equal in SQL engines that
    scale then round)."""
    if isinstance(c, str):
        c = F.col(c)
    if digits == 0:
        return F.round(c, 0)
    m = float(10 ** digits)
    return F.round(c * F.lit(m), 0) / F.lit(m)


def pround(v, digits: int):
    """:func:`rnd` for a Python float (None passes through)."""
    if v is None:
        return None
    v = float(v)
    if v != v or v in (float("inf"), float("-inf")):
        return v
    m = 10.0 ** digits
    y = v * m
    r = math.floor(abs(y) + 0.5)
    return (r if y >= 0 else -r) / m


def find_col(df: DataFrame, keywords: list[str]) -> str | None:
    """First keyword (outer loop), then first column whose lower-cased name
    contains it."""
    for kw in keywords:
        for c in df.columns:
            if kw in c.lower():
                return c
    return None


def find_features(df: DataFrame, keywords: list[str], fallback: int = 6) -> list[str]:
    """All numeric columns whose name contains any keyword; else the first
    ``fallback`` numeric columns."""
    nums = numeric_cols(df)
    hit = [c for c in nums if any(kw in c.lower() for kw in keywords)]
    return hit if hit else nums[:fallback]
