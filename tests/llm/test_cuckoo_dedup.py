"""Cuckoo index and exact groups against plain dictionaries."""

import hashlib
import random
import re

from tessera.llm import cuckoo_dedup as cd


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_insert_find_delete_resize():
    index, live = cd.CuckooIndex(buckets=2), {}
    rng = random.Random(1)
    for step in range(6000):
        k = key(rng.randrange(1500))
        if rng.random() < 0.6:
            index.insert(k)
            live[k] = live.get(k, 0) + 1
        else:
            assert index.delete(k) == (k in live)
            if k in live:
                live[k] -= 1
                if not live[k]:
                    del live[k]
    assert {k: n for k, n, _ in index.live()} == live
    assert index.resizes > 3 and len(index) == len(live)
    assert all((index.find(key(i)) >= 0) == (key(i) in live) for i in range(1500))


def test_a_fingerprint_hit_is_verified():
    index = cd.CuckooIndex(buckets=1)
    one = key(1)
    index.insert(one)
    other = one[:10] + bytes(22)  # the same place and fingerprint, another digest
    assert index.find(other) < 0 and not index.delete(other) and index.find(one) >= 0
    index.insert(other)
    assert index.find(other) != index.find(one) >= 0


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    groups = {}
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    out = []
    for i, r in enumerate(rows):
        members = groups[norm[i]]
        best = min(members, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        out.append((r[0], rows[best][0], len(members), hashlib.sha256(norm[i].encode()).hexdigest()))
    return out


def test_groups_and_edge_cases(spark):
    long = "wörd \t" * 30_000
    rows = [(5, "a b c", "x"), (2, "abc", "y"), (9, "a\tb\nc ", "z"), (1, "ab c", None), (7, None, ""), (8, "", ""), (6, " \x0b\x0c\r", ""),
            (3, "ABC", "q"), (None, "a b c", "n"), (None, "only", "n"), (4, "dup", ""), (4, "dup", ""), (10, long, ""), (11, long + " ", ""),
            (12, "ab\u00a0c", ""), (13, "𝒳y", ""), (14, "𝒳 y", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = cd.exact_dedup(df).collect()
    strip = sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got)))
    assert strip == sorted(map(str, brute(rows)))
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r.kept)
    assert all(sum(v) == 1 for v in by.values())
    assert cd.exact_dedup(df.limit(0)).count() == 0


def test_index_table(spark):
    def digests(some):
        return spark.createDataFrame([(bytearray(key(i)),) for i in some], "digest binary")

    index = cd.build_index(spark, digests([1, 2, 3, 3, 4]), 4)
    index = cd.update_index(index, digests([5, 6]), digests([2, 3, 4, 99]), 4)
    live = {bytes(r.digest): r.live for r in cd.probe_index(index, digests(range(1, 8)), 4).collect()}
    assert {i for i in range(1, 8) if live[key(i)]} == {1, 3, 5, 6}
