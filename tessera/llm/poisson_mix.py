"""Mixing sources to target weights by Poisson replication.

A source of n documents and target weight w shall give a share w of as many
documents as there are now, so its mean repetition rate is ``total * w / n``.
Every document inverts the Poisson distribution of that mean at a uniform
number seeded by a hash of its id, is repeated so many times, and all copies
are dealt out by a hash of id and copy and of the row's number in the input, and
sorted by the first: a global shuffle that any task can be rerun for, and that
spreads the rows of one id. A row without id is known by a hash of its text and
its number in the input. Rates above 500 are sums of several Poisson numbers of
equal means, as ``exp(-rate)`` would vanish otherwise.

Hot sources need no care: a source is only a row of the rates table, which is
broadcast when it has at most ``BROADCAST_SOURCES`` rows and joined otherwise.

Defined cases: a null source is a source of its own; a source without a target
weight (or with weight zero, or null) has rate 0; rows that share an id get the
same count, rows without id each their own; negative weights raise; an empty table gives an
empty result; other columns are handed on unless named like the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

SEED = 42
PIECE = 500.0
BROADCAST_SOURCES = 100_000


def _uniform(*parts: Column) -> Column:
    """52 bits of an md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def tempered_weights(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> DataFrame:
    """(source, weight): target weights in proportion to a power of the sources' sizes."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.pow(F.count(F.lit(1)), F.lit(power)).alias("w"))
    total = sizes.agg(F.sum("w")).first()[0]
    return sizes.select("source", (F.col("w") / F.lit(total)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, source_col: str = "source") -> DataFrame:
    """source, rate, pieces, cdf: the mean of each source, and the distribution
    function of a piece of it, up to where nothing is left of 52 bits."""
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    w = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("w"))
    w = w.withColumn("w", F.when(F.col("w") < 0, F.raise_error(F.lit("negative weight"))).otherwise(F.col("w")))
    rate = F.coalesce(F.col("w"), F.lit(0.0)) * docs.count() / F.col("n")
    mean = F.col("rate") / F.col("pieces")
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("cdf"))
    last = (F.ceil(mean + 12 * F.sqrt(mean)) + 30).cast("int")
    fold = F.aggregate(
        F.sequence(F.lit(1), last), start,
        lambda acc, k: F.struct(
            (acc["term"] * mean / k).alias("term"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["term"] * mean / k)).alias("cdf")),
        lambda acc: acc["cdf"])
    return (n.join(w, n["source"].eqNullSafe(w["s"]), "left")
            .select("source", rate.alias("rate")).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int"))
            .withColumn("cdf", fold))


def mix(docs: DataFrame, weights: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_copies, copy (from 0), rate and shuffle_key;
    the rows of each partition are in the order of the shuffle key. Numbers of rows
    are those of the scan, so ``docs`` should be a stored table."""
    of_source = written(rates(docs, weights, source_col), "rates")
    small = of_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    of_source = of_source.select(*[F.col(c).alias(f"__{c}") for c in of_source.columns])
    of_source = F.broadcast(of_source) if small else of_source
    text = F.coalesce(F.md5(docs[text_col].cast("string")), F.lit("")) if text_col in docs.columns else F.lit("")
    own = [c for c in docs.columns if c not in ("n_copies", "copy", "rate", "shuffle_key")]
    rows = docs.select(*[docs[c] for c in own], F.monotonically_increasing_id().alias("__row"),
                       F.when(docs[id_col].isNull(), text).alias("__text"))
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat_ws("/", F.lit(""), F.col("__text"), F.col("__row").cast("string")))
    drawn = F.transform(F.sequence(F.lit(0), F.col("__pieces") - 1), lambda j: _uniform(F.lit(str(seed)), F.col("__ident"), j.cast("string")))
    count = F.aggregate("__drawn", F.lit(0), lambda n, u: n + F.size(F.filter("__cdf", lambda c: c <= u)))
    copies = (rows.join(of_source, rows[source_col].eqNullSafe(of_source["__source"]))
              .withColumn("__ident", ident).withColumn("__drawn", drawn)
              .select(*own, "__row", "__ident", count.alias("n_copies"), F.col("__rate").alias("rate")).filter("n_copies > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1))))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.col("__ident"), F.col("copy").cast("string")))
    return (copies.withColumn("shuffle_key", key).repartition("shuffle_key", "__row").sortWithinPartitions("shuffle_key")
            .drop("__row", "__ident"))


def write_mixed(docs: DataFrame, weights: DataFrame, path: str, seed: int = SEED, id_col: str = "doc_id",
                source_col: str = "source") -> DataFrame:
    """The mixed documents, written whole to ``path`` and read back."""
    mixed = mix(docs, weights, seed, id_col, source_col)
    mixed.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(mixed.schema).parquet(path)
