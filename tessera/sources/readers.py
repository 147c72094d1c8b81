"""Table readers (S1-S3): format picked by file extension; CSV read as
text, missing-value tokens mapped to NULL, column types inferred by one
distributed aggregation of cast checks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.sources.quoted_csv import read_quoted_csv

# Text tokens read as missing (the common CSV NA spellings).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def _ext(path: str) -> str:
    p = path.rstrip("/").lower()
    for e in _FORMATS:
        if p.endswith(e):
            return e
    return os.path.splitext(p)[1]


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns to bigint / double / boolean / date / timestamp
    when every non-null value converts (one aggregation decides all
    columns); otherwise keep text."""
    checks = []
    for c in df.columns:
        x = col(c)
        nn = F.count(x)
        for kind, conv in (("bigint", F.expr(f"try_cast(`{c}` AS BIGINT)")),
                           ("double", F.expr(f"try_cast(`{c}` AS DOUBLE)")),
                           ("boolean", F.when(F.lower(x).isin("true", "false"), F.lit(True))),
                           ("date", F.expr(f"try_to_date(`{c}`, 'yyyy-MM-dd')")),
                           ("timestamp", F.expr(f"try_to_timestamp(`{c}`)"))):
            checks.append((F.count(conv) == nn).alias(f"{c}\u0001{kind}"))
    row = df.agg(*checks).collect()[0] if checks else None
    out = []
    for c in df.columns:
        kind = next((k for k in ("bigint", "double", "boolean", "date", "timestamp") if row[f"{c}\u0001{k}"]), None)
        if kind is None:
            out.append(col(c))
        elif kind == "boolean":
            out.append((F.lower(col(c)) == "true").alias(c))
        elif kind == "date":
            out.append(F.expr(f"try_to_date(`{c}`, 'yyyy-MM-dd')").alias(c))
        elif kind == "timestamp":
            out.append(F.expr(f"try_to_timestamp(`{c}`)").alias(c))
        else:
            out.append(F.expr(f"try_cast(`{c}` AS {kind.upper()})").alias(c))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, schema=None, fmt: str | None = None, multi_line: bool | str = False,
               **options) -> DataFrame:
    """Read csv / parquet / json / orc by extension (or ``fmt``).  CSV:
    header row, quotes doubled inside quotes, NA tokens to NULL, types from
    ``schema`` or inferred.  Errors surface as Spark exceptions.
    ``multi_line=True`` reads line breaks inside quotes with a task a file;
    ``"split"`` reads them from many splits of a file (see ``quoted_csv``)."""
    fmt = fmt or _FORMATS.get(_ext(path))
    if fmt is None:
        raise ValueError(f"unsupported file type: {path}")
    if fmt != "csv":
        r = spark.read.format(fmt).options(**options)
        return (r.schema(schema) if schema is not None else r).load(path)
    if multi_line == "split":
        raw = read_quoted_csv(spark, path, **options)
    else:
        raw = (spark.read.option("header", True).option("inferSchema", False)
               .option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
               .option("multiLine", multi_line).options(**options).csv(path))
    clean = raw.select(*[F.when(F.trim(col(c)).isin(NA_TOKENS) | col(c).isNull(), F.lit(None))
                         .otherwise(col(c)).alias(c) for c in raw.columns])
    if schema is not None:
        return clean.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
                              for f in schema.fields])
    return infer_types(clean)
