import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import periodic_runs as pr
from tessera.llm.queries import op12_periodic_runs


def brute(w, min_words=6):
    """Every lag, every stretch of equal words, every smaller period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i
            while i < n and w[i] == w[i - q]:
                i += 1
            a, length = s - q, i - s + q
            if length >= max(min_words, 4 * q) and not any(
                    all(w[x] == w[x + p] for x in range(a, a + length - p)) for p in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


part = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 8))


@settings(max_examples=400, deadline=None)
@given(st.lists(part, max_size=5))
def test_runs_against_brute_force(parts):
    w = [x for word, times, cut in parts for x in (word * times)[:max(1, len(word) * times - cut)]]
    assert pr.runs_of(np.array(w, np.int64)) == brute(w)


@pytest.mark.parametrize("w, runs", [
    ([0] * 50_000, [(0, 50_000, 1)]),
    ([0, 1] * 20_000, [(0, 40_000, 2)]),
    (list(range(3000)) * 4, [(0, 12_000, 3000)]),
    (list(range(3000)) * 3, []),
    ([], []), ([1], []), ([1] * 5, []), ([1] * 6, [(0, 6, 1)]),
])
def test_long_and_short_texts(w, runs):
    assert pr.runs_of(np.array(w, np.int64)) == runs


def plain(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    texts = ["a b " * 9 + "x y z " * 7, "la " * 40, "", None, "one", "a b c\x1cd " * 6, "q\tr\nq\rr " * 5,
             "a b a b a b a b c a b a b a b a b " * 2, "ab" * 500, " ".join(f"w{i % 97}" for i in range(400))]
    rows = [(i if i % 11 else None, texts[i % len(texts)], "x", 1) for i in range(160)] + [(7, "again", "x", 1), (7, "again", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain(d, t)) for d, t, *_ in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pr.find_runs(empty).count() == 0
