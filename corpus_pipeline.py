"""The corpus pipeline: stages over `documents`, each written as Parquet and
reread as the next one's input. All stages but the last return the columns of
documents; rejected rows are gone for all later stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import fm_decontam, poisson_mix, simhash_popcount, token_planes, toxicity
from tessera.llm.common import scratch_path, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says toxic go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the smallest doc_id stays."""
    return simhash_popcount.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is test phrases go."""
    return fm_decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by Poisson replication to tempered source weights, in shuffled order."""
    return poisson_mix.mix(docs, poisson_mix.tempered_weights(docs)).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode in the order of the input files, which the mixing stage has shuffled."""
    path = scratch_path(spark, "pipeline-tokens")
    token_planes.write_token_files(docs, path, token_planes.public_tokenizer(), end_id=2, order_by=None)
    return token_planes.read_token_files(spark, path)


STAGES = [("toxicity", reject_toxic), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate),
          ("source_mixing", mix_sources), ("token_output", token_output)]
#: Two stages (a trained model, a tokenizer) are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
