import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import gga_packing as gp
from tessera.llm.byte_tokens import ChunkIds
from tessera.llm.token_planes import public_tokenizer

BPE = public_tokenizer("byte_bpe_50k.json")


def test_ids_are_the_tokenizers():
    ids, rng = ChunkIds(BPE), random.Random(3)
    parts = ["a", "B", "foo", "'s", "'ll", "\n", " ", "  ", "\t", " ", "é", "ß", "中", "١", "9", "!?", "<|endoftext|>", "<|", "'",
             "\x1c", "\x85", " ", "　", "👍", "ŉ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert ids.merge is not None
    assert ids.encode(texts) == [ids.whole(t) for t in texts]


def test_a_distinct_word_is_looked_up_once(monkeypatch):
    seen, plain = [], ChunkIds._of
    monkeypatch.setattr("tessera.llm.byte_tokens.CACHE_WORDS", 60)
    ids, rng = ChunkIds(BPE), random.Random(4)
    monkeypatch.setattr(ChunkIds, "_of", lambda self, words: seen.append(words.to_pylist()) or plain(self, words))
    pool = [f"w{i}" for i in range(40)] + ["中文", "été", "日x", "\u0301a", "ÿ", ""]
    for _ in range(6):
        pool += [f"v{rng.randrange(99)}", f"щ{rng.randrange(9)}"]
        texts = [" ".join(rng.choice(pool) for _ in range(300)) + " x" for _ in range(20)] + ["", "one", "ends ", " starts"]
        assert ids.encode(texts) == [ids.whole(t) for t in texts]
    split = [w for some in seen for w in some]
    assert len(seen) == 6 and all(len(some) == len(set(some)) for some in seen) and len(split) <= 6 * (len(pool) + 2)


def checked(rows, texts, capacity):
    """Every piece once, as cut from plain ids; sequences gapless and not too long. Number of sequences."""
    ids, by_doc, by_seq = ChunkIds(BPE), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for doc, text in texts:
        one = np.array(ids.tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(one) - 1) % capacity + 1
        cuts = [0, *range(first, len(one) + 1, capacity)]
        want[doc] += [(k, a, b - a, zlib.crc32(one[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for doc in want.keys() | by_doc.keys():
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc]) == sorted(want[doc])
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("shard_items", [60, 2048])
def test_pack(spark, shard_items):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "delta's", "42"]) for _ in range(rng.randint(1, 90)))) for i in range(400)]
    texts += [(None, None), (None, "x"), (3, "again"), (3, "again"), (900, ""), (901, "word " * 700)]
    docs = spark.createDataFrame([(d, t, "s", 5) for d, t in texts], "doc_id long, text string, key string, length int")
    rows = gp.pack(docs, BPE, capacity=128, shard_items=shard_items).collect()
    sizes = sorted((r["length"] for r in rows), reverse=True)
    plain = gp.best_fit(sizes, 128, range(len(sizes))).merit[0]  # all pieces in one task
    assert checked(rows, texts, 128) <= plain * (1 if shard_items > 1000 else 1.03)
    assert gp.pack(docs.limit(0), BPE).count() == 0


def test_least_bins_is_a_bound():
    rng = np.random.default_rng(2)
    for _ in range(300):
        sizes = rng.integers(1, rng.choice([20, 64, 100]), rng.integers(1, 9)).tolist()
        least = gp.least_bins(sizes, 100)

        def fits(left, bins):  # brute force: can the items go into so many sequences?
            return not left or any(fits(left[1:], bins[:k] + [b + left[0]] + bins[k + 1:])
                                   for k, b in enumerate(bins) if b + left[0] <= 100 and b not in bins[:k])
        assert least == 1 or not fits(sorted(sizes, reverse=True), [0] * (least - 1))
    assert gp.least_bins([60] * 5 + [50] * 2 + [45], 100) == 7


def test_evolution_beats_best_fit():
    """Islands of sizes that best fit, longest first, packs with loss."""
    rng = np.random.default_rng(5)
    sizes = sorted(rng.integers(300, 1100, 600).tolist(), reverse=True)
    plain = gp.best_fit(sizes, 2048, range(len(sizes)))
    best = []
    for _ in range(3):
        best = gp.evolve(sizes, 2048, best, rng)
    assert best[0].merit < plain.merit
    assert sorted(i for some in best[0].items for i in some) == list(range(600))
    assert all(sum(sizes[i] for i in some) == f <= 2048 for some, f in zip(best[0].items, best[0].fills))
    again = gp.Solution.load(best[0].assigned(), sizes)
    assert again.merit == best[0].merit
