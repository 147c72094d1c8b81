"""Packing documents into sequences of a fixed number of tokens by a grouping
genetic algorithm.

A document of more tokens than a sequence holds is cut from its end, so that its
first piece may be shorter; full pieces are sequences of their own. The other
pieces are items, dealt by hash into shards of about ``SHARD_ITEMS``. A shard is
solved by ``ISLANDS`` populations, each a row of a table. In an epoch a population

* crosses two solutions: whole well-filled sequences of one are put into the
  other, sequences there that hold the same items are dissolved, and the
  displaced items go, longest first, where they fit best;
* mutates by dissolving its emptiest sequences and a few others;

and between epochs the best solution of every island moves on to the next one.
Sequences of the best island that are not filled well, up to ``RELEASE`` of a
shard's items, are dissolved and their items dealt into fewer shards, until one
shard is left, so that what a shard wastes does not add up. All tables that carry
on are written to the shared folder; a task holds one shard at a time, and the
driver only counts.

Defined cases: a null or empty text is a document of the end id alone; rows of
one id, or of none, are documents of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.byte_tokens import chunks_of
from tessera.llm.common import id_text, written

CAPACITY = 2048
SHARD_ITEMS = 2048
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 3, 10, 6
#: Sequences below this share of the capacity may be dissolved for the next
#: level, the emptiest first, up to this share of a shard's items.
FILLED, RELEASE = 0.995, 0.3

PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _portions(batch: pa.RecordBatch, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``size`` bytes of text, or one longer row."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield batch.slice(at, to - at)
        at = to


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, end = chunks_of(tokenizer), np.array([end_id], "<u4").tobytes()
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for part in _portions(batch):
                for doc, ids in zip(part.column(0).to_pylist(), chunks.encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        to = at + ((n - at - 1) % capacity + 1)
                        out.append((key, doc, piece, at, to - at, zlib.crc32(ids[4 * at:4 * to])))
                        at, piece, key = to, piece + 1, key + 1
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 names=["key", "doc_id", "piece", "start", "length", "ids_crc32"])
    return run


class Bins:
    """A packing that is being built: best fit by a stack of sequences for every
    number of free places, and one bit a number that has any."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def _offer(self, b: int) -> None:
        r = self.room[b]
        if r:
            if not self.by_room[r]:
                self.mask |= 1 << r
            self.by_room[r].append(b)

    def add(self, items: list[int], fill: int) -> None:
        self.items.append(items)
        self.room.append(self.capacity - fill)
        self._offer(len(self.items) - 1)

    def place(self, item: int) -> None:
        """Into the fullest sequence that has room, or into a new one."""
        size = self.sizes[item]
        fits = self.mask >> size
        if not fits:
            self.add([item], size)
            return
        r = size + (fits & -fits).bit_length() - 1
        b = self.by_room[r].pop()
        if not self.by_room[r]:
            self.mask ^= 1 << r
        self.items[b].append(item)
        self.room[b] = r - size
        self._offer(b)


class Solution:
    """Items of every sequence, their fills, and the order of merit."""

    def __init__(self, items: list[list[int]], fills: list[int]):
        self.items, self.fills = items, fills
        self.merit = (len(items), -sum(f * f for f in fills))

    @classmethod
    def of(cls, bins: Bins) -> Solution:
        return cls(bins.items, [bins.capacity - r for r in bins.room])

    @classmethod
    def load(cls, assigned: np.ndarray, sizes: list[int]) -> Solution:
        items: list[list[int]] = [[] for _ in range(int(assigned.max()) + 1)]
        for i, b in enumerate(assigned.tolist()):
            items[b].append(i)
        return cls(items, [sum(sizes[i] for i in some) for some in items])

    def assigned(self) -> np.ndarray:
        out = np.empty(sum(map(len, self.items)), "<i4")
        for b, some in enumerate(self.items):
            out[some] = b
        return out


def best_fit(sizes: list[int], capacity: int, order) -> Solution:
    bins = Bins(sizes, capacity)
    for i in order:
        bins.place(i)
    return Solution.of(bins)


def _rebuild(keep: list[tuple[list[int], int]], displaced: list[int], sizes: list[int], capacity: int) -> Solution:
    bins = Bins(sizes, capacity)
    for items, fill in keep:
        bins.add(list(items), fill)
    for i in sorted(displaced, key=lambda i: -sizes[i]):
        bins.place(i)
    return Solution.of(bins)


def cross(a: Solution, b: Solution, sizes: list[int], capacity: int, rng: np.random.Generator) -> Solution:
    """Half of the well-filled sequences of ``b`` put into ``a``."""
    fills = np.array(b.fills)
    good = np.flatnonzero(fills >= np.median(fills))
    chosen = good[rng.random(len(good)) < 0.5].tolist()
    inside = {i for k in chosen for i in b.items[k]}
    keep = [(b.items[k], b.fills[k]) for k in chosen]
    displaced: list[int] = []
    for items, fill in zip(a.items, a.fills):
        if inside.isdisjoint(items):
            keep.append((items, fill))
        else:
            displaced += [i for i in items if i not in inside]
    return _rebuild(keep, displaced, sizes, capacity)


def mutate(s: Solution, sizes: list[int], capacity: int, rng: np.random.Generator) -> Solution:
    """Dissolve the emptiest sequences and as many others."""
    n = len(s.items)
    some = max(1, n // 50)
    gone = set(np.argsort(s.fills, kind="stable")[:some].tolist()) | set(rng.integers(0, n, some).tolist())
    keep = [(s.items[k], s.fills[k]) for k in range(n) if k not in gone]
    return _rebuild(keep, [i for k in gone for i in s.items[k]], sizes, capacity)


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer sequences: for a threshold, items beyond half the
    capacity never share one, those within the threshold of it share with none of
    the items from the threshold on, and what of these doesn't fit beside the
    others needs more."""
    s = np.sort(np.array(sizes, np.int64))
    total = np.concatenate([[0], np.cumsum(s)])
    half, best = int(np.searchsorted(s, capacity // 2, "right")), -(-int(total[-1]) // capacity)
    for a in np.unique(s[:half]).tolist():
        low, top = int(np.searchsorted(s, a)), int(np.searchsorted(s, capacity - a, "right"))
        beside = (top - half) * capacity - int(total[top] - total[half])
        best = max(best, len(s) - half + max(0, -(-(int(total[half] - total[low]) - beside) // capacity)))
    return max(best, len(s) - half)


def evolve(sizes: list[int], capacity: int, population: list[Solution], rng: np.random.Generator,
           generations: int = GENERATIONS, size: int = POPULATION) -> list[Solution]:
    """A population after so many generations, best first; it begins with best
    fit, longest first, and the same in loosened orders. It ends early where no
    packing can have fewer sequences."""
    least = least_bins(sizes, capacity)
    by_size = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    if not population:
        population = [best_fit(sizes, capacity, by_size)]
    while len(population) < size and min(s.merit[0] for s in population) > least:
        loose = np.array(sizes) * rng.uniform(0.7, 1.0, len(sizes))
        population.append(best_fit(sizes, capacity, np.argsort(-loose, kind="stable").tolist()))
    population.sort(key=lambda s: s.merit)
    for _ in range(generations):
        if population[0].merit[0] <= least or len(population) < 2:
            break
        children = []
        for _ in range(2):
            i, j = sorted(rng.choice(len(population), 2, replace=False).tolist())
            children.append(cross(population[j], population[i], sizes, capacity, rng))
        children.append(mutate(population[int(rng.integers(len(population)))], sizes, capacity, rng))
        seen, kept = set(), []
        for s in sorted(population + children, key=lambda s: s.merit):
            if s.merit not in seen:
                seen.add(s.merit)
                kept.append(s)
        population = kept[:size]
    return population


_STATE = "shard long, island int, population array<binary>, n_bins int, squares long, least int"


def _epoch(capacity: int, epoch: int, seed: int):
    """Rows (shard, island, sizes, population, migrant) -> the populations after the epoch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = row["sizes"]
                given = [p for p in [row["migrant"], *(row["population"] or [])] if p is not None]
                rng = np.random.default_rng([seed, epoch, row["island"], row["shard"] & 0x7FFFFFFF])
                out = evolve(sizes, capacity, [Solution.load(np.frombuffer(p, "<i4"), sizes) for p in given], rng)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]], pa.int64()), pa.array([row["island"]], pa.int32()),
                     pa.array([[s.assigned().tobytes() for s in out]], pa.list_(pa.binary())),
                     pa.array([out[0].merit[0]], pa.int32()), pa.array([out[0].merit[1]], pa.int64()),
                     pa.array([least_bins(sizes, capacity)], pa.int32())],
                    names=["shard", "island", "population", "n_bins", "squares", "least"])
    return run


_PLACED = PIECES + ", sequence_id long, offset long, released boolean"


def _place(capacity: int, release: float):
    """Rows (shard, items, best) -> items with their sequence and place there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items, sizes = row["items"], row["sizes"]
                s = Solution.load(np.frombuffer(row["best"], "<i4"), sizes)
                may, gone = release * len(sizes), set()
                for k in np.argsort(s.fills, kind="stable").tolist():
                    may -= len(s.items[k])
                    if may < 0 or s.fills[k] >= FILLED * capacity:
                        break
                    gone.add(k)
                out = []
                for k, some in enumerate(s.items):
                    offset, first = 0, items[some[0]]["key"]
                    for i in some:
                        it = items[i]
                        out.append((it["key"], it["doc_id"], 0, 0, sizes[i], it["ids_crc32"], first, offset, k in gone))
                        offset += sizes[i]
                kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 names=["key", "doc_id", "piece", "start", "length", "ids_crc32",
                                                        "sequence_id", "offset", "released"])
    return run


def _solve(items: DataFrame, n_shards: int, level: int, capacity: int, seed: int) -> DataFrame:
    """One level: items dealt into shards, solved on islands, placed."""
    spark = items.sparkSession
    dealt = items.groupBy(F.pmod(F.xxhash64("key", F.lit(level)), F.lit(n_shards)).alias("shard")).agg(
        F.sort_array(F.collect_list(F.struct("length", "key", "doc_id", "ids_crc32")), asc=False).alias("items"))
    shards = written(dealt.select("shard", "items", F.col("items.length").alias("sizes")), "packing-shards")
    work = shards.select("shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    tasks = max(1, min(n_shards * ISLANDS, 4 * spark.sparkContext.defaultParallelism, n_shards // 4 + 8))
    state = None
    for epoch in range(EPOCHS):
        if state is None:
            rows = work.select("shard", "island", "sizes", F.lit(None).cast("array<binary>").alias("population"),
                               F.lit(None).cast("binary").alias("migrant"))
        else:
            moved = state.select("shard", F.expr(f"(island + 1) % {ISLANDS}").alias("island"),
                                 F.col("population")[0].alias("migrant"))
            rows = (work.join(state.select("shard", "island", "population"), ["shard", "island"])
                    .join(moved, ["shard", "island"]).select("shard", "island", "sizes", "population", "migrant"))
        state = written(rows.repartition(tasks, "shard", "island").mapInArrow(_epoch(capacity, epoch, seed), _STATE),
                        "packing-islands")
        if state.where("n_bins > least").isEmpty():
            break
    best = state.groupBy("shard").agg(F.min_by(F.col("population")[0], F.struct("n_bins", "squares", "island")).alias("best"))
    placed = (shards.join(best, "shard").select("shard", "items", "sizes", "best")
              .mapInArrow(_place(capacity, RELEASE if n_shards > 1 else 0.0), _PLACED))
    return written(placed, "packing-placed")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS,
         seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: key (one number a piece), doc_id, piece, start, length,
    ids_crc32, sequence_id (the key of its first piece) and offset in it."""
    texts = id_text(docs, id_col, text_col)
    pieces = written(texts.mapInArrow(_cut(tokenizer, end_id, capacity), PIECES), "packing-pieces")
    out = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("key"), "offset": F.lit(0).cast("long")})
    items, level = pieces.where(F.col("length") < capacity), 0
    n = items.count()
    while n:
        n_shards = -(-n // shard_items)
        placed = _solve(items, n_shards, level, capacity, seed)
        out = out.unionByName(placed.where("not released").drop("released"))
        items, level = placed.where("released").select(*[f.split()[0] for f in PIECES.split(", ")]), level + 1
        n = items.count()
    return out
