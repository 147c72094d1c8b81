"""Deterministic hash-ordered sampling (Sm1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col


def hash_text(key: list[str], seed: int) -> Column:
    """md5 hex of ``key`` values and the seed joined by '-'."""
    return F.md5(F.concat_ws("-", *[col(k).cast("string") for k in key], F.lit(str(seed))))


def hash_long(key: list[str], seed: int) -> Column:
    """First 13 hex digits (52 bits) of :func:`hash_text` as a BIGINT; exact
    as a double, so it can be ranked by the order-statistic routine."""
    return F.conv(F.substring(hash_text(key, seed), 1, 13), 16, 10).cast("bigint")


def sample_n(df: DataFrame, n: int, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest md5(key, seed) (ties by key): a
    seeded sample, reproducible in any engine with md5.  Each task keeps
    only its own top ``n`` before the final merge."""
    key = key or df.columns
    h = hash_text(key, seed)
    return df.orderBy(h, *[col(k) for k in key]).limit(n)
