"""Removed bytes against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import suffix_hash_dedup as sd


def brute(texts):
    """[(id, bytes)] in order -> [(n_bytes, n_removed, spans, sha)]."""
    first, out = set(), []
    for _, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 99):
            s = t[i:i + 100]
            if s in first:
                gone[i:i + 100] = True
            else:
                first.add(s)
        flags = gone[:len(t)]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
        kept = bytes(np.frombuffer(t, np.uint8)[~flags])
        out.append((len(t), int(flags.sum()), [tuple(map(int, e)) for e in edge.reshape(-1, 2)], hashlib.sha256(kept).hexdigest()))
    return out


def answer(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], r.kept_sha256)
                  for r in sd.remove_repeats(df).collect())


def planted(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop é"
    word = lambda k: "".join(rng.choices(letters, k=k))
    passages = [word(rng.choice([99, 100, 101, 130, 300, 700])) for _ in range(12)]
    line, docs = word(60), []
    for i in range(n):
        parts = [word(rng.randrange(0, 400))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            parts += [p[a:], rng.choice(["", line, word(30)]), word(rng.randrange(0, 200))]
        docs.append("".join(parts))
    docs[5], docs[17], docs[30] = docs[3], docs[3][:-20] + "x" + docs[3][-19:], "ab" * 400
    docs[31], docs[32], docs[33] = "ab" * 300, "z" * 5000, ""
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = planted(seed)
    ids = list(range(len(docs)))
    want = brute([(i, d.encode()) for i, d in zip(ids, docs)])
    order = ids[:]
    random.Random(seed).shuffle(order)
    assert answer(spark, [(i * 10, docs[i]) for i in order]) == [(i * 10, *want[i]) for i in ids]


def test_crowded_and_frequent_anchors(spark, monkeypatch):
    """Groups beyond CROWD and anchors from the sample take the single-string way."""
    docs = planted(3)
    want = brute([(i, d.encode()) for i, d in enumerate(docs)])
    monkeypatch.setattr(sd, "SAMPLE", 2)
    monkeypatch.setattr(sd, "FREQUENT_IN_SAMPLE", 3)
    assert answer(spark, list(enumerate(docs))) == [(i, *w) for i, w in enumerate(want)]


def test_sorter_orders_suffixes():
    rng = random.Random(4)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + b"ab" * 300
    items = np.array(rng.sample(range(len(data) - 100), 700))
    group = np.sort(np.array([rng.randrange(5) for _ in items]))
    order = sd.SuffixSorter(data).sort(items, group)
    want = sorted(range(len(items)), key=lambda i: (group[i], data[items[i]:items[i] + 100], i))
    assert order.tolist() == want


def test_strings_made_to_collide():
    """Thue-Morse words have equal polynomial hashes modulo 2**64: the bytes decide."""
    def word(n, c):
        return bytes(c ^ (bin(i).count("1") & 1) for i in range(n))
    one, two = word(2048, 97)[:2048], bytes(x ^ 1 for x in word(2048, 97))
    h = [sd.prefix_hashes(np.frombuffer(w, np.uint8))[-1] for w in (one, two)]
    assert h[0] == h[1] and one != two
    rows = [(7, d, 0, 0, w[:100]) for d, w in ((1, one), (2, two), (3, one))]
    doc, start, stop = sd.repeats(rows)
    assert list(zip(doc, start, stop)) == [(3, 0, 100)]


def test_edge_cases(spark):
    s = planted(5, 40)
    rows = [(4, s[3]), (4, s[3]), (2, s[8]), (2, s[3]), (None, s[3]), (None, None), (9, ""), (9, None), (11, s[3] * 2)]
    keyed = {(r[0], (r[1] or "")) for r in rows}
    from xxhash import xxh64_intdigest
    sign = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(keyed, key=lambda k: (k[0] is not None, k[0] or 0, sign(xxh64_intdigest(k[1].encode(), 42))))
    want = dict(zip(order, brute([(k[0], k[1].encode()) for k in order])))
    got = answer(spark, rows)
    assert got == sorted((-1 if r[0] is None else r[0], *want[(r[0], r[1] or "")]) for r in rows)
    assert answer(spark, []) == []


def in_process(docs, hot=()):
    """All steps without Spark (whose tasks import their own constants): removed intervals by document."""
    import zstandard
    texts = pa.RecordBatch.from_pydict({"doc": list(range(len(docs))), "text": [d.encode() for d in docs]})
    found = pa.Table.from_batches(sd._scan(iter([texts]))).sort_by([(c, "ascending") for c in ("a", "x", "doc", "at")])
    parts = pa.Table.from_batches(sd._meet(np.array(hot, np.int64))(found.to_batches(max_chunksize=7))).to_pylist()
    gone = [(p["doc"], p["start"], p["stop"]) for p in parts if p["kind"] == 0]
    asked = {}
    for p in parts:
        if p["kind"]:
            asked.setdefault(p["doc"], []).append({k: p[k] for k in ("kind", "start", "stop", "a", "o")})
    z = zstandard.ZstdCompressor()
    rows = pa.RecordBatch.from_arrays([pa.array(list(asked), pa.int64()), pa.array([z.compress(docs[d].encode()) for d in asked]),
                                       pa.array(list(asked.values()))], names=["doc", "z", "parts"])
    fetched = pa.Table.from_batches(sd._fetch(iter([rows.slice(0, 9), rows.slice(9)])))
    fetched = fetched.sort_by([(c, "ascending") for c in ("kind", "a", "x", "doc", "start")])
    for b in sd._settle(fetched.to_batches(max_chunksize=11)):
        gone += list(zip(*(c.to_pylist() for c in b.columns)))
    out = []
    for i in range(len(docs)):
        mine = [g for g in gone if g[0] == i]
        _, s, e = sd.merged(*(np.array(c, np.int64) for c in zip(*mine))) if mine else ([], [], [])
        out.append([(int(x), int(y)) for x, y in zip(s, e)])
    return out, {p["kind"] for p in parts}


@pytest.mark.parametrize("crowd", [512, 2, 0])
def test_crowded_groups_go_singly(monkeypatch, crowd):
    monkeypatch.setattr(sd, "CROWD", crowd)
    docs = planted(7)
    got, kinds = in_process(docs)
    assert got == [w[2] for w in brute([(i, d.encode()) for i, d in enumerate(docs)])]
    assert kinds == ({0, 1} if crowd == 512 else {0, 1, 2} if crowd else {0, 2})


def test_long_text_is_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 1 << 12)
    sd._Powers.up = None
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh ", k=9000))
    docs = [long[2000:2600], long, long[1000:7000] + "q" * 500, long[:50] + long[8000:]]
    want = brute([(i, d.encode()) for i, d in enumerate(docs)])
    got, _ = in_process(docs)
    assert got == [w[2] for w in want]
    sd._Powers.up = None
