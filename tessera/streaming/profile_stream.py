"""Running column profile over a stream.

The reference analyses one static table; this module keeps the same
mergeable column statistics (counts, nulls, mean, std, min, max) up to
date while new files of that table arrive, using Structured Streaming's
state store (complete output mode), so a growing table never has to be
rescanned.  Quantiles and distinct counts are not mergeable exactly and
stay batch-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import num, numeric_cols
from tessera.functions.frames import explode_structs


def running_profile(stream: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Streaming aggregate: one row per column with rows, non_null, mean,
    std (sample), min, max."""
    cols = cols or numeric_cols(stream)
    row = stream.agg(F.count(F.lit(1)).alias("__rows"),
                     *[F.count(num(stream, c)).alias(f"n{i}") for i, c in enumerate(cols)],
                     *[F.avg(num(stream, c)).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_samp(num(stream, c)).alias(f"s{i}") for i, c in enumerate(cols)],
                     *[F.min(num(stream, c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                     *[F.max(num(stream, c)).alias(f"hi{i}") for i, c in enumerate(cols)])
    return explode_structs(row, [F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"),
                                          F.col(f"n{i}").alias("non_null"), F.col(f"m{i}").alias("mean"),
                                          F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
                                          F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)])


def profile_files(spark: SparkSession, path: str, schema, checkpoint: str, query_name: str = "profile",
                  cols: list[str] | None = None):
    """Start a streaming profile over parquet files arriving in ``path``
    into an in-memory table ``query_name``; returns the StreamingQuery.
    ``checkpoint`` must be a shared folder on a cluster."""
    stream = spark.readStream.schema(schema).parquet(path)
    return (running_profile(stream, cols).writeStream.outputMode("complete").format("memory")
            .queryName(query_name).option("checkpointLocation", checkpoint).start())
