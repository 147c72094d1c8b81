"""Exact round trips of token files."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_planes as tp

TRICKY = ["a  b c <|endoftext|>x Σas ΣΑΣ İx ﬁ é '́ 'S 'LL it's ½ ª² µ ÿ Ÿ ß ẞ a<b a|b |", "", "\n", "a\x01b \x01", " lead and trail ",
          "Don't, stop! (we'll) 42nd\tTab", "日本語 テキスト 𝒳", "'tis l'été's x'll'd", "\u00a0nbsp\u2003em\u3000wide\x85next\x1cfs"]


def plain_ids(texts):
    t = Tokenizer.from_file(tp.public_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 4095, 4096, 10_000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    assert (tp.unpack(tp.pack(ids, 4096, bits), n, 4096, bits) == ids).all()


def test_words_equal_whole_texts(spark):
    texts = TRICKY + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = tp.WordIds(tp.public_tokenizer())
    assert words.by_word and words.by_piece
    assert [np.frombuffer(words.encode(t), "<u4").tolist() for t in texts] == plain_ids(texts)


def test_special_tokens_in_other_case():
    texts = ["see <|EndOfText|> here", "<|ENDOFTEXT|>", "A <|endoftext|> B<|StartOfText|>C", "<|startoftext|>Don't <| Stop |> <|x"]
    words = tp.WordIds(tp.public_tokenizer())
    assert [np.frombuffer(words.encode(t), "<u4").tolist() for t in texts] == plain_ids(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokenizer_that_keeps_white_space(name):
    words = tp.WordIds(tp.public_tokenizer(name))
    t = Tokenizer.from_file(tp.public_tokenizer(name))
    for text in TRICKY:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("order_by", ["doc_id", None])
def test_files_round_trip(spark, tmp_path, order_by):
    long = "The long text, again and again. " * 12_000
    rows = [(7, "seven words are here", "x"), (3, None, "x"), (5, "", None), (3, "three", "x"), (None, "no id", "x"), (3, "three", "x"),
            (11, long, "x")] + [(100 + i, t, "x") for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
    path = str(tmp_path / "tokens")
    tp.write_token_files(df, path, tp.public_tokenizer(), end_id=2, order_by=order_by, chunk_ids=50)
    got = sorted(tp.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want = [ids + [2] for ids in plain_ids([r[1] for r in rows])]
    have = [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    assert sorted(map(str, ((r.doc_id, i) for r, i in zip(got, have)))) == sorted(map(str, zip([r[0] for r in rows], want)))
    at = 0
    for r, ids in zip(got, have):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    if order_by:
        order = [r.doc_id for r in got]
        assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    index = spark.read.parquet(path + "/index")
    assert index.agg({"n_ids": "sum"}).first()[0] == at


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    tp.write_token_files(df, str(tmp_path / "t"), tp.public_tokenizer(), end_id=2)
    assert tp.read_token_files(spark, str(tmp_path / "t")).count() == 0
