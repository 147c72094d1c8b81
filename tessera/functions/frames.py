"""Frame-level helpers: multi-pass inputs, tall (unpivoted) results."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col


@contextmanager
def multipass(df: DataFrame, cols: list[str] | None = None):
    """Project to ``cols`` and persist for an operator that scans its input
    several times (quantile refinement, model fits).  When the input has
    fewer partitions than the cluster has cores (a small single-file
    table) it is spread first; on large inputs this is a no-op."""
    spark = df.sparkSession
    work = df.select(*[col(c) for c in cols]) if cols is not None else df
    par = spark.sparkContext.defaultParallelism
    if work.rdd.getNumPartitions() < par:
        work = work.repartition(par)
    work = work.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield work
    finally:
        work.unpersist()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: row numbers given
    before stay as they are, whatever is lost or run again."""
    from tessera.session import checkpoint_dir
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def explode_structs(row_df: DataFrame, structs: list[Column], keep: list[str] | None = None) -> DataFrame:
    """Turn one wide aggregate row per group into tall rows: ``structs`` are
    struct Columns with identical field names/types, one per output row."""
    keep = keep or []
    return (row_df.select(*[col(k) for k in keep], F.explode(F.array(*structs)).alias("__s"))
            .select(*[col(k) for k in keep], "__s.*"))
