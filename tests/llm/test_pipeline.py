"""Stages and the whole pipeline on a small corpus with planted cases."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402

from tessera.llm import fm_decontam, poisson_mix, simhash_popcount, token_planes, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """(input, output) of every stage, written and read as in run()."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "x")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(kept):
    assert [n for n, _ in cp.STAGES] == list(kept)
    for name, (before, after) in list(kept.items())[:-1]:
        assert after.schema.names == before.schema.names


def test_toxic_documents_go(spark, kept):
    before, after = kept["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == sorted(r.doc_id for r in toxicity.score(before, model).filter("predicted = 0").collect())
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert len(toxic - set(ids(after))) <= 2


def test_one_of_each_group_stays(kept):
    before, after = kept["simhash_near_dedup"]
    groups = simhash_popcount.near_groups(before).collect()
    assert ids(after) == sorted({r.component_id for r in groups})
    assert len(ids(after)) < len(groups)


def test_contaminated_documents_go(spark, kept):
    before, after = kept["benchmark_decontamination"]
    found = fm_decontam.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(after) == ids(found.filter(~fm_decontam.is_contaminated()))
    assert after.count() < before.count()


def test_mixing_repeats_by_rate(kept):
    before, after = kept["source_mixing"]
    mixed = poisson_mix.mix(before, poisson_mix.tempered_weights(before))
    assert ids(after) == ids(mixed) and ids(after) != ids(before)


def test_tokens_round_trip(kept):
    before, after = kept["token_output"]
    rows = sorted(after.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    words = token_planes.words_of(token_planes.public_tokenizer())
    want = sorted((r.doc_id, len(words.encode(r.text)) // 4 + 1) for r in before.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == want


def test_run_equals_the_stages(spark, kept):
    got = cp.run(spark, SF)
    assert ids(got) == ids(kept["token_output"][1])
