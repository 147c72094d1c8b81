import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie as pt

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda z: z[:2])] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode().split()) if s else 0
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids.get(s, 0), leaves[s], saved[s],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(s)))).encode()).hexdigest())
                  for s, m in members.items())


def nodes(spark, rows, rebuild):
    arrays = pt.turn_arrays(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string, words int"))
    return sorted(tuple(r) for r in pt.trie(pt.with_borrowed_heads(arrays) if rebuild else arrays).select(*COLS).collect())


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_against_brute_force(spark, rebuild, coalesce, monkeypatch):
    """Hot first turns, equal conversations, long ones, nulls, repeated turns; one or eight shards."""
    monkeypatch.setattr(pt, "ENDS_BLOCK", 3)  # in this process only: blocks of the crossing nodes
    rng, rows = random.Random(7), [(None, 1, "a", "b")]
    for c in range(90):
        kind = rng.random()
        for t in range(3 if kind < 0.35 else rng.choice([1, 2, 5, 17, 40])):
            rows.append((c, t if rng.random() < 0.95 else None, "u" if kind < 0.5 else rng.choice(["u", None]),
                         "x y z" if rng.random() < 0.8 or kind < 0.35 else rng.choice(["a  b", "c", None, ""])))
    rows += [(3, 0, "u", "x y z"), (3, 0, "u", "x y z")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = nodes(spark, [(*r, "clash", 1) for r in rows], rebuild)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, rebuild)


def test_small_tables(spark):
    assert nodes(spark, [(5, None, None, None, "", 0)], True) == brute([(5, None, None, None)], True)
    empty = hashlib.sha256(b"").hexdigest()
    assert nodes(spark, [(5, 1, "u", "a", "", 0)], False) == [
        (5, 0, None, 1, 1, 1, 0, empty), (5, 1, 5, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert pt.trie(pt.turn_arrays(none)).count() == 0
