"""Removal of repeated byte strings by hash-compared suffix sorting.

Every byte that a string of ``LENGTH`` (100) bytes covers which also starts
earlier in the corpus is removed. The suffixes to sort are those of all places
where such a string can start, dealt out so that equal strings meet:

1. A string's *anchor* is its 24-gram of least hash (a minimizer), so equal
   strings have equal anchors at equal distances. A scan task rolls polynomial
   prefix hashes over its texts and cuts them into *runs*: the neighbouring
   strings with one anchor occurrence, about 40 of them.
2. Runs meet by anchor. Of runs with the same content all but the first are
   removed outright; an anchor with one content is done with. The first runs of
   an anchor with several contents share some of their strings at most.
3. For those the bytes are fetched, and the suffixes at the strings' starts are
   merge-sorted, all groups of a batch at once: two suffixes are compared by
   binary search for their common extension over prefix hashes, a logarithmic
   number of steps. Neighbours that the hashes call equal over 100 bytes are
   verified byte by byte, and all of a class but the first are removed.
4. The removed intervals return to their documents.

Hot groups: equal runs merge inside a scan block before the shuffle. Anchors that
are frequent in a sample of the documents (a list of bounded size that only
steers rows) are dealt out by anchor and content. The strings of these, and of
anchors with more than ``CROWD`` contents, are not sorted in one group: they are
dealt out singly, by two independent hashes of their 100 bytes, after merging
inside the task. So no step holds a group that grows with the corpus.

Defined cases: a null text is empty; texts below 100 bytes lose nothing; rows
that share id and text are one document and get the same result; rows that share
an id alone are ordered by a hash of their text, null ids come first; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: Bytes that are hashed at a time; a longer text is cut with an overlap.
BLOCK = 1 << 20
CROWD = 512
#: One document in so many is looked at for frequent anchors.
SAMPLE = 64
FREQUENT_IN_SAMPLE = 20
FREQUENT = 50_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, made once a worker."""
    up = down = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None:
            n = BLOCK + 4 * LENGTH
            cls.up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, _BASE, _U)]))
            cls.down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, pow(_BASE, -1, 1 << 64), _U)]))
        return cls.up, cls.down


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """hash(i, j) = (out[j] - out[i]) * down[i] depends on the bytes i..j-1 alone."""
    up, _ = _Powers.get()
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:len(data)], out=out[1:])
    return out


def runs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, count, anchor place, anchor hash) of the runs of texts laid end to
    end, as places in ``data``; ``first`` is the first string's start."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, _U)
    _, down = _Powers.get()
    p = prefix_hashes(data)
    h = (p[GRAM:] - p[:-GRAM]) * down[:len(data) - GRAM + 1]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    # the low bits hold the place, so that the least key also tells it; of equal hashes the leftmost wins
    bits = _U((1 << (BLOCK + 4 * LENGTH).bit_length()) - 1)
    key = np.full(-(-len(h) // SPAN) * SPAN, np.iinfo(_U).max)
    key[:len(h)] = (h & ~bits) | np.arange(len(h), dtype=_U)
    blocks, n = key.reshape(-1, SPAN), len(data) - LENGTH + 1
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    right = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    place = (np.minimum(left[:n], right[SPAN - 1:SPAN - 1 + n]) & bits).astype(np.int64)
    change = np.zeros(n + 1, np.int32)
    long = lens >= LENGTH
    np.add.at(change, starts[long], 1)
    np.add.at(change, starts[long] + lens[long] - LENGTH + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    new, last = valid.copy(), valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    last[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    first = np.flatnonzero(new)
    return first, np.flatnonzero(last) - first + 1, place[first], h[place[first]]


# One row a run: anchor, content hash, document, and start, distance of the anchor
# and number of strings packed. A row of an interval that is already known to be
# removed has at < 0: a is the document, x the start, -at the length.
RUNS = "a long, x long, doc long, at long"


def _run_rows(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Runs of a block of (document, offset, bytes); equal ones merged."""
    from xxhash import xxh64_intdigest

    raw = b"".join(p[2] for p in pieces)
    lens = np.array([len(p[2]) for p in pieces], np.int64)
    starts = np.cumsum(lens) - lens
    first, count, place, a = runs(np.frombuffer(raw, np.uint8), starts, lens)
    x = np.array([xxh64_intdigest(raw[i:j]) for i, j in zip(first.tolist(), (first + count + LENGTH - 1).tolist())], _U)
    of = np.repeat(np.arange(len(pieces)), lens)[first] if len(first) else np.zeros(0, np.int64)
    doc = np.array([p[0] for p in pieces], np.int64)[of]
    start = first - starts[of] + np.array([p[1] for p in pieces], np.int64)[of]
    order = np.lexsort((start, doc, x, a))
    again = np.zeros(len(order), bool)
    again[1:] = (a[order][1:] == a[order][:-1]) & (x[order][1:] == x[order][:-1])
    keep, gone = order[~again], order[again]
    at = start << 16 | (place - first) << 8 | count
    d, s, e = merged(doc[gone], start[gone], start[gone] + count[gone] + LENGTH - 1)
    cols = [np.concatenate([a[keep].view(np.int64), d]), np.concatenate([x[keep].view(np.int64), s]),
            np.concatenate([doc[keep], d]), np.concatenate([at[keep], s - e])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "x", "doc", "at"])


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals united where they overlap or touch, by document."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    width = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * width)  # a group's reaches are above all of the group before
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] + group[1:] * width > reach[:-1])])
    cut = np.flatnonzero(new)
    ends = np.concatenate([cut[1:], [len(doc)]]) - 1
    return doc[cut], start[cut], reach[ends] - group[cut] * width


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces, size = [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py()
            for at in range(0, max(1, len(t) - LENGTH + 1), BLOCK // 2):
                part = t[at:at + BLOCK // 2 + LENGTH - 1]
                pieces.append((doc, at, part))
                size += len(part)
                if size >= BLOCK // 2:
                    yield _run_rows(pieces)
                    pieces, size = [], 0
    if pieces:
        yield _run_rows(pieces)


# Kind 0: a removed interval; 1 and 2: strings start..stop-1 of a run to compare,
# in a group or singly, with its anchor and the anchor's distance.
PARTS = "kind int, doc long, start long, stop long, a long, o int"


def _meet(hot: np.ndarray):
    """Rows of RUNS sorted by a, x, doc, at -> PARTS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, x, doc, at = rows
            known = at < 0
            parts = [(np.zeros(int(known.sum()), np.int32), doc[known], x[known], x[known] - at[known],
                      np.zeros(int(known.sum()), np.int64), np.zeros(int(known.sum()), np.int32))]
            a, x, doc, at = rows[:, ~known]
            start, o, count = at >> 16, (at >> 8 & 255).astype(np.int32), at & 255
            if len(a):
                group = np.concatenate([[True], a[1:] != a[:-1]])
                content = group | np.concatenate([[True], x[1:] != x[:-1]])
                number = np.cumsum(group) - 1
                contents = np.bincount(number, weights=content)[number]
                frequent = np.isin(a, hot)
                kind = np.where(~content, 0, np.where(frequent | (contents > CROWD), 2, np.where(contents > 1, 1, -1)))
                some = kind >= 0
                stop = np.where(content, start + count, start + count + LENGTH - 1)
                parts.append((kind[some].astype(np.int32), doc[some], start[some], stop[some], a[some], o[some]))
            cols = [np.concatenate(c) for c in zip(*parts)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "doc", "start", "stop", "a", "o"])

        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            # a group may go on in the next batch, unless its anchor is frequent: then contents are all that counts
            last = rows[:, -1:]
            same = rows[0] == last[0]
            if np.isin(last[0], hot)[0]:
                same &= rows[1] == last[1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield out(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            elif held and (held[-1][0, -1] != rows[0, 0] or (np.isin(last[0], hot)[0] and held[-1][1, -1] != rows[1, 0])):
                yield out(np.concatenate(held, axis=1))
                held = []
            held.append(rows[:, cut:])
        if held:
            yield out(np.concatenate(held, axis=1))
    return run


# Kind 0: a removed interval; 1: a run's bytes by anchor; 2: one string by two hashes (a, x).
BYTES = "kind int, a long, x long, doc long, start long, stop long, o int, bytes binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, z, parts) -> BYTES. Single strings that a task has twice are settled here."""
    import zstandard
    from xxhash import xxh64_intdigest

    d = zstandard.ZstdDecompressor()
    singles: dict[tuple[int, int], tuple[int, int]] = {}

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                          names=["kind", "a", "x", "doc", "start", "stop", "o", "bytes"])

    def flush() -> pa.RecordBatch:
        rows = [(2, k[0], k[1], v[0], v[1], v[1] + LENGTH, 0, None) for k, v in singles.items()]
        singles.clear()
        return out(rows)

    for b in batches:
        rows = []
        for doc, z, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            text = d.decompress(z)
            for p in parts:
                raw = text[p["start"]:p["stop"] + LENGTH - 1]
                if p["kind"] == 1:
                    rows.append((1, p["a"], 0, doc, p["start"], p["stop"], p["o"], raw))
                    continue
                h = prefix_hashes(np.frombuffer(raw, np.uint8))
                n = len(raw) - LENGTH + 1
                _, down = _Powers.get()
                h1 = ((h[LENGTH:] - h[:n]) * down[:n]).view(np.int64).tolist()
                for j in range(n):
                    h2 = xxh64_intdigest(raw[j:j + LENGTH])
                    key, here = (h1[j], h2 - (1 << 64) if h2 >> 63 else h2), (doc, p["start"] + j)
                    there = singles.get(key)
                    if there is not None:
                        later = max(here, there)
                        rows.append((0, later[0], 0, later[0], later[1], later[1] + LENGTH, 0, None))
                        here = min(here, there)
                    singles[key] = here
        yield out(rows)
        if len(singles) > 200_000:
            yield flush()
    yield flush()


class SuffixSorter:
    """Suffixes of one byte string, compared over their first LENGTH bytes."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.hashes = prefix_hashes(self.data)
        self.down = _Powers.get()[1]
        head = np.zeros(len(self.data) - 7, _U)
        for i in range(8):
            head = head << _U(8) | self.data[i:len(head) + i]
        self.head = head

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension up to LENGTH, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), LENGTH, np.int64)
        pa_, pb, da, db = self.hashes[a], self.hashes[b], self.down[a], self.down[b]
        for _ in range(LENGTH.bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.hashes[a + mid] - pa_) * da == (self.hashes[b + mid] - pb) * db
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def below(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b (or is equal, where asked)."""
        ha, hb = self.head[a], self.head[b]
        out = ha < hb
        tied = np.flatnonzero(ha == hb)
        if len(tied):
            a, b = a[tied], b[tied]
            n = self.extension(a, b)
            whole = n == LENGTH
            at = np.minimum(n, LENGTH - 1)
            out[tied] = np.where(whole, or_equal[tied], self.data[a + at] < self.data[b + at])
        return out

    def sort(self, items: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Stable order of the suffixes ``items`` within groups (ascending numbers):
        bottom-up merges of all groups at once; each element finds its place in
        the neighbouring run by binary search."""
        n = len(items)
        start = np.searchsorted(group, group, "left")
        size = np.searchsorted(group, group, "right") - start
        local, order, width = np.arange(n) - start, np.arange(n), 1
        while n and width < size.max():
            todo = np.flatnonzero(size > width)
            t = local[todo]
            in_right = (t // width) % 2 == 1
            mine = t - t % width
            other = np.where(in_right, mine - width, mine + width)
            lo, hi = np.zeros(len(todo), np.int64), np.clip(size[todo] - other, 0, width)
            base, me = start[todo] + other, items[order[todo]]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                there = items[order[base[open_] + mid]]
                # a left element goes after the right ones below it, a right one after the left ones not above it
                before = self.below(there, me[open_], in_right[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            to = start[todo] + np.minimum(mine, other) + t % width + lo
            moved = order.copy()
            moved[to] = order[todo]
            order, width = moved, width * 2
        return order

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether LENGTH bytes are equal: by hash, then byte by byte."""
        out = np.zeros(len(a), bool)
        claimed = np.flatnonzero(self.extension(a, b) == LENGTH)
        reach = np.arange(LENGTH)
        for i in range(0, len(claimed), 20_000):
            some = claimed[i:i + 20_000]
            out[some] = (self.data[a[some][:, None] + reach] == self.data[b[some][:, None] + reach]).all(axis=1)
        if not out[claimed].all():
            raise _Collision
        return out


class _Collision(Exception):
    """Prefix hashes call different strings equal."""


def repeats(rows: list[tuple[int, int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed intervals of runs (anchor, document, start, distance, bytes): the
    strings that an earlier document, or an earlier start, has as well."""
    lens = np.array([len(r[4]) for r in rows], np.int64)
    base, count = np.cumsum(lens) - lens, lens - LENGTH + 1
    of = np.repeat(np.arange(len(rows)), count)
    j = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    anchor = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
    group = anchor[of] * 256 + (np.array([r[3] for r in rows], np.int64)[of] - j)
    doc, at = np.array([r[1] for r in rows], np.int64)[of], np.array([r[2] for r in rows], np.int64)[of] + j
    order = np.lexsort((at, doc, group))
    order = order[np.isin(group[order], np.flatnonzero(np.bincount(group) > 1))]
    group, doc, at, items = group[order], doc[order], at[order], (base[of] + j)[order]
    raw = b"".join(r[4] for r in rows)
    try:
        sorter = SuffixSorter(raw)
        place = sorter.sort(items, group)
        s, g = items[place], group[place]
        again = np.zeros(len(s), bool)
        near = np.flatnonzero(g[1:] == g[:-1])
        again[near + 1] = sorter.same(s[near], s[near + 1])
        gone = place[again]
    except _Collision:
        # the exact way for strings made to collide: the bytes themselves
        seen: set = set()
        gone = []
        for i, (p, k) in enumerate(zip(items.tolist(), group.tolist())):
            if (k, raw[p:p + LENGTH]) in seen:
                gone.append(i)
            seen.add((k, raw[p:p + LENGTH]))
        gone = np.array(gone, np.int64)
    return merged(doc[gone], at[gone], at[gone] + LENGTH)


REMOVED = "doc long, start long, stop long"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BYTES sorted by kind, a, x, doc, start -> REMOVED."""
    def out(doc, start, stop) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (doc, start, stop)],
                                          names=["doc", "start", "stop"])

    rows, size, single = [], 0, None
    for b in batches:
        plain: list[tuple[int, int, int]] = []
        for kind, a, x, doc, start, stop, o, raw in zip(*(c.to_pylist() for c in b.columns)):
            if kind == 0:
                plain.append((doc, start, stop))
            elif kind == 1:
                if size > BLOCK // 2 and rows[-1][0] != a:
                    yield out(*repeats(rows))
                    rows, size = [], 0
                rows.append((a, doc, start, o, raw))
                size += len(raw)
            elif (a, x) == single:
                plain.append((doc, start, stop))
            else:
                single = (a, x)
        if plain:
            yield out(*merged(*(np.array(c, np.int64) for c in zip(*plain))))
    if rows:
        yield out(*repeats(rows))


RESULT = ("doc long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, "
          "kept_sha256 string, kept binary")
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _cut(with_kept: bool):
    """(doc, z, gone) -> RESULT."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, z, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                text, kept, spans, at = d.decompress(z), [], [], 0
                for g in sorted((g["start"], g["stop"]) for g in gone or ()):
                    if spans and g[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], g[1])
                    else:
                        spans.append([*g])
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                whole = b"".join([*kept, text[at:]])
                rows.append((doc, len(text), len(text) - len(whole), [{"first": s, "last": e} for s, e in spans],
                             hashlib.sha256(whole).hexdigest(), whole if with_kept else None))
            types = [pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                             names=["doc", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.compress(t.as_py()) for t in b.column(1)], pa.binary())],
                                         names=["doc", "z"])


def _frequent(docs: DataFrame) -> np.ndarray:
    """Anchors that occur often in a sample of the documents; at most FREQUENT."""
    sample = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    counts = (sample.mapInArrow(_scan, RUNS).filter("at >= 0").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= FREQUENT_IN_SAMPLE).orderBy(F.desc("n"), "a").limit(FREQUENT))
    return np.array([r.a for r in counts.collect()], np.int64)


def removed(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """RESULT for documents (doc: unique long, text: binary); smaller ``doc`` is earlier."""
    hot = _frequent(docs)
    met, key = docs.mapInArrow(_scan, RUNS), F.col("a")
    if len(hot):  # a frequent anchor's rows spread by content
        listed = docs.sparkSession.createDataFrame([(a,) for a in hot.tolist()], "f long")
        met = met.join(F.broadcast(listed), met["a"] == listed["f"], "left")
        key = F.when(F.col("f").isNotNull(), F.xxhash64("a", "x")).otherwise(F.col("a"))
    parts = written(met.repartition(key).select("a", "x", "doc", "at").sortWithinPartitions("a", "x", "doc", "at")
                    .mapInArrow(_meet(hot), PARTS), "runs")
    texts = docs.mapInArrow(_packed, "doc long, z binary")
    asked = (parts.filter("kind > 0").groupBy("doc").agg(F.collect_list(F.struct("kind", "start", "stop", "a", "o")).alias("parts")))
    settled = (texts.join(asked, "doc").select("doc", "z", "parts").mapInArrow(_fetch, BYTES)
               .repartition("a").sortWithinPartitions("kind", "a", "x", "doc", "start").mapInArrow(_settle, REMOVED))
    gone = (parts.filter("kind = 0").select("doc", "start", "stop").union(settled)
            .groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("gone")))
    return texts.join(gone, "doc", "left").select("doc", "z", "gone").mapInArrow(_cut(with_kept), RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed, in bytes), kept_sha256 and, if
    asked for, the kept bytes of every row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    ids = rows.select("doc_id")
    unique = not (ids.filter("doc_id IS NULL").limit(1).count()
                  or ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count())
    out = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"] + ["kept"] * with_kept
    if unique:
        return removed(rows.withColumnRenamed("doc_id", "doc"), with_kept).withColumnRenamed("doc", "doc_id").select(*out)
    # ids that are null or repeat: number the distinct (id, text) in order
    keyed = rows.withColumn("h", F.xxhash64("text"))
    order = keyed.select("doc_id", "h").distinct().orderBy(F.asc_nulls_first("doc_id"), "h")
    numbers = written(order.rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1]))
                      .toDF("i long, g long, doc long"), "numbers")
    same = keyed["doc_id"].eqNullSafe(numbers["i"]) & (keyed["h"] == numbers["g"])
    numbered = written(keyed.join(numbers, same).select("doc", "doc_id", "text"), "numbered")
    result = removed(numbered.select("doc", "text").dropDuplicates(["doc"]), with_kept)
    return numbered.select("doc", "doc_id").join(result, "doc").select(*out)
