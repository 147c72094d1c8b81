"""Benchmark decontamination with an FM-index per shard of the corpus.

A scan task cuts its documents into shards of a few megabytes of text. A shard's
words become symbols: the benchmark's words have one each, every other word ends
a run. Runs shorter than the shortest test phrase cannot hold one and are left
out; over the others the task builds a suffix array (prefix doubling), the
Burrows-Wheeler transform with a wavelet matrix for ranks, and sampled suffix
positions. All test phrases are searched backwards at once, occurrences are
located by walking to a sampled position, and their words are merged to spans.

The benchmark is the stated query set: it is taken in blocks of bounded size
(``block_bytes`` of text each), so what a task holds of it has a bound too.

Defined cases: null or empty texts have no words and no hits; an item without
words is no phrase; items of one id count once, those without an id as one more
item, which has no place in the ids' digest; rows with the
same doc_id are judged one by one; empty tables give
empty results or no hits; other columns are ignored; a text longer than a shard
is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_text, written

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
SAMPLE_EVERY = 8

_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and bytes above 0x7F."""
    return text.lower().translate(_WORDS).split()


class Phrases:
    """Test phrases of a block of the benchmark as rows of symbols."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        rows: dict[tuple, int] = {}
        pairs = set()
        for item, text in items:
            words = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words_of(text)]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                phrase = tuple(words[at:at + window])
                pairs.add((rows.setdefault(phrase, len(rows)), NO_ID if item is None else item))
        self.lens = np.array([len(p) for p in rows], np.int64)
        self.table = np.zeros((len(rows), window), np.int64)
        for p, r in rows.items():
            self.table[r, :len(p)] = p
        pairs = sorted(pairs)
        self.pair_items = np.array([i for _, i in pairs], np.int64)
        self.pair_from = np.searchsorted(np.array([r for r, _ in pairs], np.int64), np.arange(len(rows) + 1))
        self.shortest = int(self.lens.min()) if len(rows) else 0


class FMIndex:
    """Backward search and locate over runs of symbols (each >= 1).

    ``text`` holds the runs, each followed by a 0; the zeros count as different
    symbols in text order, so that no comparison goes beyond a run."""

    def __init__(self, text: np.ndarray, every: int = SAMPLE_EVERY):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        symbols = text + len(ends)
        symbols[ends] = np.arange(len(ends))
        order = np.argsort(symbols, kind="stable")
        rank = self._ranks(order, symbols[order])
        width = 1
        while n and rank[order[-1]] < n - 1:
            # a rank's tie breaks by the rank `width` further on; a tie can't reach over a run's end
            after = np.zeros(n, np.int64)
            after[:-width] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank = self._ranks(order, key[order])
            width *= 2
        before = np.concatenate([text[-1:], text[:-1]]) if n else text
        self.n, bwt = n, before[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))])
        self.levels = max(1, int(text.max(initial=0)).bit_length())
        self.ones, self.zeros, now = [], [], bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.bwt = bwt
        start = np.zeros(n, bool)
        start[0:1] = True
        start[ends[:-1] + 1] = True
        place = order
        kept = start[place] | (place % every == 0)
        self.sample_at = np.cumsum(kept) - 1
        self.samples = place[kept]
        self.kept = kept

    @staticmethod
    def _ranks(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])]) if len(order) else out
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before ``at``."""
        lo, hi = np.zeros_like(at), at
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def search(self, table: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, lo, hi) of the phrases that occur."""
        alive = np.flatnonzero((lens > 0) & (table.max(axis=1, initial=0) < len(self.first) - 1)) if self.n else np.zeros(0, int)
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for step in range(int(lens.max(initial=0))):
            at = lens[alive] - 1 - step
            live = at >= 0
            c = table[alive, np.maximum(at, 0)]
            new_lo = np.where(live, self.first[c] + self.rank(c, lo), lo)
            new_hi = np.where(live, self.first[c] + self.rank(c, hi), hi)
            some = new_lo < new_hi
            alive, lo, hi = alive[some], new_lo[some], new_hi[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.kept[at])
        while len(walking):
            row = at[walking]
            c = self.bwt[row]
            at[walking] = self.first[c] + self.rank(c, row)
            steps[walking] += 1
            walking = walking[~self.kept[at[walking]]]
        return self.samples[self.sample_at[at]] + steps


def _runs(codes: np.ndarray, doc_of: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place): runs of known words of one document that are long enough,
    each followed by a 0, and every symbol's word number in the shard."""
    known = codes > 0
    cut = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (doc_of[1:] != doc_of[:-1])]))
    length = np.diff(np.concatenate([cut, [len(codes)]]))
    good = known[cut] & (length >= shortest)
    starts, length = cut[good], length[good]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offset = np.cumsum(length + 1) - (length + 1)
    place = np.arange(int((length + 1).sum())) - np.repeat(offset, length + 1) + np.repeat(starts, length + 1)
    ends = offset + length
    inside = np.minimum(place, len(codes) - 1)
    text = codes[inside]
    text[ends] = 0
    return text, place


def scan_shard(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: number of words, hit spans (first word, one past the last), items."""
    get, codes, lens = phrases.symbols.get, [], []
    for t in texts:
        words = words_of(t)
        lens.append(len(words))
        codes += [get(w, 0) for w in words]
    code, lens = np.array(codes, np.int64), np.array(lens, np.int64)
    first = np.cumsum(lens) - lens
    none = [(int(n), [], []) for n in lens]
    if not len(code) or not phrases.shortest:
        return none
    doc_of = np.repeat(np.arange(len(texts)), lens)
    text, place = _runs(code, doc_of, phrases.shortest)
    index = FMIndex(text)
    found, lo, hi = index.search(phrases.table, phrases.lens)
    if not len(found):
        return none
    times = hi - lo
    rows = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
    phrase = np.repeat(found, times)
    at = place[index.locate(rows)]
    change = np.zeros(len(code) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.lens[phrase], -1)
    hit = (np.cumsum(change[:-1]) > 0).astype(np.int8)
    # spans of hit words that end with their document
    edge = np.concatenate([[True], (hit[1:] != hit[:-1]) | (doc_of[1:] != doc_of[:-1])])
    cut = np.flatnonzero(edge)
    stop = np.concatenate([cut[1:], [len(code)]])
    out = none
    for a, b in zip(cut[hit[cut] > 0].tolist(), stop[hit[cut] > 0].tolist()):
        d = doc_of[a]
        out[d][1].append((int(a - first[d]), int(b - first[d])))
    seen = np.unique(np.stack([doc_of[at], phrase], axis=1), axis=0)
    items: dict[int, set] = {}
    for d, p in seen.tolist():
        items.setdefault(d, set()).update(phrases.pair_items[phrases.pair_from[p]:phrases.pair_from[p + 1]].tolist())
    for d, some in items.items():
        out[d][2].extend(sorted(some))
    return out


#: Stands for a null item id inside a task.
NO_ID = -(1 << 63)
HITS = "doc_id long, h long, n_words long, spans array<struct<first:int,last:int>>, items array<long>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _shards(texts: list[bytes], shard_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``shard_bytes``."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= shard_bytes:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _scan(phrases: Phrases, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _shards(texts, shard_bytes):
                got = scan_shard(texts[a:b], phrases)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array([g[0] for g in got], pa.int64()),
                     pa.array([[{"first": x, "last": y} for x, y in g[1]] for g in got], _SPANS),
                     pa.array([[i for i in g[2] if i != NO_ID] + [None] * (NO_ID in g[2]) for g in got], pa.list_(pa.int64()))],
                    names=["doc_id", "h", "n_words", "spans", "items"])
    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks that the driver and each task can hold; at least one."""
    items = (benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[text_col].cast("string").alias("text"))
             .filter("text IS NOT NULL"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-int(size) // block_bytes) or 1
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield Phrases([(r[0], r[1].encode()) for r in part.collect()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, spans (hit words, merged), items (ids
    of items with an occurring phrase, ascending, null last)."""
    rows = id_text(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text, window, block_bytes)
    result, more = rows.mapInArrow(_scan(next(blocks), shard_bytes), HITS), None
    for phrases in blocks:
        hits = written(rows.mapInArrow(_scan(phrases, shard_bytes), HITS).filter(F.size("items") > 0), "hits")
        more = hits if more is None else more.unionByName(hits)
    if more is not None:
        result = _merged(result, more)
    return result.select("doc_id", "n_words", "spans", "items")


def _merged(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Add the other blocks' hits to each row of the first block's result."""
    same = more.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("s2"),
                                           F.flatten(F.collect_list("items")).alias("i2")).withColumnsRenamed(
        {"doc_id": "d2", "h": "h2"})
    both = rows.join(same, rows["doc_id"].eqNullSafe(same["d2"]) & (rows["h"] == same["h2"]), "left")
    spans = F.array_sort(F.concat("spans", F.coalesce("s2", F.slice("spans", 1, 0))))
    merge = lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["first"] <= F.try_element_at(acc, F.lit(-1))["last"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(acc, F.lit(-1))["first"].alias("first"),
            F.greatest(F.try_element_at(acc, F.lit(-1))["last"], s["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(s)))
    empty = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    return both.select("doc_id", "h", "n_words", F.aggregate(spans, empty, merge).alias("spans"),
                       F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i2", F.slice("items", 1, 0))))).alias("items"))


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])


def is_contaminated():
    """At least one word in twenty is part of a test phrase."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      window: int = WINDOW, item_col: str = "item_id", item_text: str = "text",
                      block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows that are not contaminated, with all columns.

    With one block of the benchmark a row is judged where it is read, without a
    shuffle; with several, verdicts return by id and text."""
    blocks = list(_at_most(2, _blocks(benchmark, item_col, item_text, window, block_bytes)))
    if len(blocks) == 1:
        place, phrases = docs.columns.index(text_col), blocks[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [(t or "").encode() for t in batch.column(place).to_pylist()]
                keep = []
                for a, b in _shards(texts, shard_bytes):
                    for n, spans, _ in scan_shard(texts[a:b], phrases):
                        hit = sum(y - x for x, y in spans)
                        keep.append(not (hit and 20 * hit >= n))
                yield batch.filter(pa.array(keep, pa.bool_()))
        return docs.mapInArrow(run, docs.schema)
    bad = (contamination(docs.withColumn(id_col, F.xxhash64(F.coalesce(text_col, F.lit("")))), benchmark, window, id_col,
                         text_col, item_col, item_text, block_bytes, shard_bytes)
           .filter(is_contaminated()).select("doc_id").distinct())
    return docs.join(bad, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["doc_id"], "left_anti")


def _at_most(n: int, things: Iterator) -> Iterator:
    for _, x in zip(range(n), things):
        yield x


def items_sha256(items: str = "items"):
    """Of the ids as strings, sorted and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda i: i.cast("string")))), 256)
