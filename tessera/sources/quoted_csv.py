"""CSV with line breaks inside quotes, read from many splits of a file.

Spark's own reader takes such a file as one task.  Here lines are read as text, split
anywhere; each is numbered within its block (the split that it was read from), with the
parity of the quotes before it.  One row a block gives the state in which each block starts;
with it every line knows the line that its record began with.  Records of one line
go straight on, the lines of the others meet by record.

Quotes must be used as in RFC 4180: only around whole fields, doubled inside."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.frames import stored
from tessera.functions.ranking import small

_LINE = "path string, block long, i long, p int, q int, s0 long, s1 long, value string"


def _number(batches):
    """Lines of a task with their place ``i`` in the block, the parity of the block's quotes before (p) and
    after (q) them, and the last line up to them that had an even (s0) or an odd (s1) parity before it (-1: none)."""
    here, i, p, last = None, 0, 0, [-1, -1]
    for b in batches:
        paths, blocks = b.column(0).to_pylist(), b.column(1).to_numpy()
        quotes = pc.count_substring(b.column(2), '"').to_numpy(zero_copy_only=False) % 2
        place, before, after, starts = (np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int32),
                                        np.zeros(b.num_rows, np.int32), np.zeros((2, b.num_rows), np.int64))
        for row, (path, block, odd) in enumerate(zip(paths, blocks.tolist(), quotes.tolist())):
            if (path, block) != here:
                here, i, p, last = (path, block), 0, 0, [-1, -1]
            last[p] = i
            place[row], before[row], after[row], starts[0, row], starts[1, row] = i, p, p ^ odd, last[0], last[1]
            i, p = i + 1, p ^ odd
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place), pa.array(before), pa.array(after), pa.array(starts[0]),
                                          pa.array(starts[1]), b.column(2)], names=["path", "block", "i", "p", "q", "s0", "s1", "value"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, record): the records of the CSV files at ``path``, each with the block and the number of
    the line that it begins with; line breaks inside quotes are kept, blank records are left out. A file that ends
    inside a quote has its rest as one record."""
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = text.mapInArrow(_number, _LINE)
    order = Window.partitionBy("path").orderBy("block")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (lines.groupBy("path", "block").agg(F.max("i").alias("end"), F.max_by("q", "i").alias("odd"), F.max("s0").alias("l0"), F.max("s1").alias("l1"))
              .withColumn("open", F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2)
              .withColumn("begun", F.when(F.col("open") == 0, F.col("l0")).otherwise(F.col("l1")))
              .withColumn("carry", F.last(F.when(F.col("begun") >= 0, F.struct(F.col("block").alias("b"), F.col("begun").alias("l"))), True).over(ahead))
              .select("path", "block", "end", "open", "carry"))
    at = lines.join(small(stored(blocks, "blocks")), ["path", "block"], "left")
    known = F.when(F.col("open").isNull() | (F.col("i") > F.col("end")), F.raise_error(F.lit("the files were split otherwise between two passes")).cast("long")).otherwise(F.col("open"))
    own = F.when(known == 0, F.col("s0")).otherwise(F.col("s1"))
    at = at.select("path", "block", "i", "value", own.alias("own"), "carry", ((F.col("p") == known) & (F.col("q") == known)).alias("single"))
    alone = at.where("single").select("path", "block", F.col("i").alias("line"), F.col("value").alias("record"))
    parts = at.where("not single").select(
        "path", F.when(F.col("own") >= 0, F.col("block")).otherwise(F.col("carry.b")).alias("start"),
        F.when(F.col("own") >= 0, F.col("own")).otherwise(F.col("carry.l")).alias("line"), F.struct("block", "i", "value").alias("part"))
    joined = (parts.groupBy("path", "start", "line").agg(F.sort_array(F.collect_list("part")).alias("parts"))
              .select("path", F.col("start").alias("block"), "line", F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("record")))
    clean = F.regexp_replace("record", r"\r\z", "")
    return alone.unionByName(joined).withColumn("record", clean).where("record != ''")


def read_quoted_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """The CSV files at ``path`` with all columns as text. The first record of each file is its header,
    the first file's header names the columns. Files without a record: no columns, no rows."""
    found = records(spark, path)
    first = stored(found.where("block = 0").groupBy("path").agg(F.min(F.struct("line", "record")).alias("h")), "headers")
    head = first.orderBy("path").select("h.record").first()
    if head is None:
        return spark.createDataFrame([], "")
    parse = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "multiLine": "true", **{k: str(v) for k, v in options.items()}}
    names = spark.read.options(**parse).option("header", False).csv(spark.sparkContext.parallelize([head["record"]], 1)).first()
    names = [n if n is not None else f"_c{i}" for i, n in enumerate(names)]
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    body = found.join(small(first.select("path", F.lit(0).cast("long").alias("block"), F.col("h.line").alias("line"))), ["path", "block", "line"], "left_anti")
    return body.select(F.from_csv("record", schema, parse).alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
