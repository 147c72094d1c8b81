"""Fingerprints and components against brute force."""

import re

import pytest
from xxhash import xxh64_intdigest

from tessera.llm import simhash_popcount as sp


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """{row: smallest id} by search over all pairs; fps: [(id, fp)]."""
    seen, out = set(), {}
    for i in range(len(fps)):
        if i in seen:
            continue
        todo, members = [i], []
        seen.add(i)
        while todo:
            a = todo.pop()
            members.append(a)
            for b in range(len(fps)):
                if b not in seen and bin(fps[a][1] ^ fps[b][1]).count("1") <= 2:
                    seen.add(b)
                    todo.append(b)
        ids = [fps[m][0] for m in members if fps[m][0] is not None]
        out |= {m: min(ids) if ids else None for m in members}
    return out


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_against_brute_force(spark, small):
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in sp.near_groups(small).collect()}
    rows = [(r.doc_id, brute_fp(r.text)) for r in small.collect()]
    want = brute_components(rows)
    assert len(got) == len(rows)
    for i, (doc, fp) in enumerate(rows):
        assert got[doc] == (fp, want[i])


def test_families_larger_than_a_cell(spark, monkeypatch):
    monkeypatch.setattr(sp, "PAIRS_UP_TO", 4)
    base = [0x0123456789ABCDEF, 0xFEDCBA9876543210, 0]
    fps = {b ^ (1 << i) for b in base for i in range(0, 64, 5)} | set(base) | {b ^ 0b111 << 20 for b in base}
    fps |= {0xF0F0 << 40 ^ (0b11 << 2 * i) for i in range(8)} | {1 << 63, 3 << 62, (1 << 64) - 1}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    edges = sp.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    root = {r.node: r.root for r in sp.components(edges).collect()}
    want = brute_components([(f, f & (1 << 64) - 1) for f in signed])
    assert [root.get(f, f) for f in signed] == [want[i] for i in range(len(signed))]


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    rows = [(3, None, "x"), (1, "", "y"), (2, " \t\n", None), (None, "a b c d e", "z"), (7, "A b\tc  d E", "z"),
            (7, "A b\tc  d E", "z"), (9, "one", "fp"), (10, "One", "fp"), (11, long, "q"), (12, long, "q"), (None, "lonely text here now", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sp.near_groups(df).collect()
    want = brute_components([(r[0], brute_fp(r[1])) for r in rows])
    assert sorted(map(str, ((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got))) == sorted(
        map(str, ((r[0], brute_fp(r[1]), want[i]) for i, r in enumerate(rows))))
    kept = sp.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "11", "7", "9", "None"]
    assert sp.near_groups(df.limit(0)).count() == 0


def test_rows_without_or_with_repeated_ids_stay(spark):
    texts = [f"{w} one two three {w * 2} four five {w * 3} six" for w in ("alpha", "beta", "gamma", "delta", "omega")]
    fps = [brute_fp(t) for t in texts]
    assert all(bin(a ^ b).count("1") > 2 for i, a in enumerate(fps) for b in fps[:i])
    rows = [(None, texts[0], 1), (None, texts[1], 2), (None, texts[1], 3), (5, texts[2], 4), (5, texts[3], 5), (4, texts[3], 6),
            (5, texts[4], 7), (5, texts[4], 8), (None, texts[4], 9)]
    kept = sp.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, row long").coalesce(1))
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted(r.row for r in kept.collect()) == [1, 2, 4, 6, 7]


def test_cells_are_never_broadcast(spark, monkeypatch):
    """Spark takes the cells for as many as the fingerprints; there are up to 33 of each, and they don't fit the driver."""
    plans, plain = {}, sp.written
    monkeypatch.setattr(sp, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or plain(df, name))
    fps = plain(spark.range(50).selectExpr("xxhash64(id) AS fp"), "few")
    assert sp.links(fps).count() == 0
    assert "SortMergeJoin" in plans["met"] and "Broadcast" not in plans["met"]
