"""Writers (S4-S6): CSV with header, named result exports, the insights
text report."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 CSV with a header row (one file per partition); quotes are doubled."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def write_result(df: DataFrame, base: str, name: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Export a named result (processed, train, test, stats, loadings,
    predictions, clustered, ...) under ``base/name``."""
    path = f"{base.rstrip('/')}/{name}"
    if fmt == "csv":
        write_csv(df, path, mode)
    else:
        df.write.mode(mode).format(fmt).save(path)
    return path


def write_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ordered text lines (a single ``value`` column) as one text file."""
    lines.coalesce(1).write.mode(mode).text(path)
