"""FM-index, spans and verdicts against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import fm_decontam as fd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    phrases = {(i, tuple(w[a:a + 13])) for i, t in items for w in [words(t)]
               for a in range(max(1, len(w) - 12) if w else 0)}
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for i, p in phrases:
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a:a + len(p)]) == p:
                    hit |= set(range(a, a + len(p)))
                    found.add(i)
        sha = hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


def query(found):
    return sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.sha, r.bad) for r in found.selectExpr("*").withColumns(
        {"n_hit": fd.n_hit(), "sha": fd.items_sha256(), "bad": fd.is_contaminated()}).selectExpr(
        "doc_id", "n_words", "n_hit", "size(items) n_items", "sha", "bad").collect())))


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["É", "ünï", "x9"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([3, 5, 12, 13, 14, 30, 45]))) for i in range(12)] + [(12, None), (13, "  ...  "), (None, text(4)), (2, text(14))]
    docs = []
    for i in range(50):
        t = text(rng.randrange(0, 80))
        if rng.random() < 0.6:
            p = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(p) - 13))
            t += rng.choice([" ", ", ", "\n- "]) + " ".join(p[a:]).upper().replace("É", "É") + " " + text(rng.randrange(0, 30))
        docs.append((i, t))
    docs += [(60, None), (61, ""), (63, items[-2][1]), (62, docs[3][1]), (62, docs[3][1]), (None, items[5][1]), (70, " ".join(w for _, t in items[:6] for w in t.split()) * 3)]
    return docs, items


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_against_brute_force(spark, block):
    docs, items = make(1)
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = fd.contamination(d, b, block_bytes=block, shard_bytes=700)
    assert query(got) == brute(docs, items)
    kept = fd.drop_contaminated(d, b, block_bytes=block, shard_bytes=700)
    assert kept.columns == d.columns
    bad = {s for s in brute(docs, items) if s.endswith("True)")}
    assert kept.count() == len(docs) - len([s for s in brute(docs, items) if s in bad])


def test_empty_tables(spark):
    docs, items = make(2)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert fd.contamination(d.limit(0), b).count() == 0
    assert query(fd.contamination(d, b.limit(0))) == brute(docs, [])
    assert fd.drop_contaminated(d, b.limit(0)).count() == len(docs)


def test_index_search_and_locate():
    rng = random.Random(3)
    text = []
    for _ in range(40):
        text += [rng.randrange(1, 6) for _ in range(rng.randrange(1, 60))] + [0]
    text += [1, 2] * 200 + [0]
    t = np.array(text)
    index = fd.FMIndex(t.copy())
    table = np.array([[rng.randrange(1, 6) for _ in range(4)] for _ in range(80)] + [[1, 2, 1, 2]])
    lens = np.array([rng.randrange(1, 5) for _ in range(80)] + [4])
    found, lo, hi = index.search(table, lens)
    got = {int(f): sorted(index.locate(np.arange(a, b)).tolist()) for f, a, b in zip(found, lo, hi)}
    for i, (p, n) in enumerate(zip(table.tolist(), lens.tolist())):
        want = [a for a in range(len(text) - n + 1) if text[a:a + n] == p[:n]]
        assert got.get(i, []) == want
