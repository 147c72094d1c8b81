"""Exact deduplication with a cuckoo-filter index of text digests.

Texts are equal when they agree after white space is deleted; the key of a text
is the SHA-256 of what is left. Digests are dealt out by hash to buckets, and
each bucket holds a cuckoo filter of 16-bit fingerprints beside the stored keys.
A filter miss proves a digest new; a hit is verified against the stored keys of
the two candidate slots' bucket; when an insertion finds no free slot, the table
is doubled and rebuilt from the stored keys. Digests can be deleted again.

Hot texts: each scan task merges its own equal digests before the shuffle, so a
text that a third of all rows share reaches its bucket as one row a task; the
verdicts return by a join that adaptive execution may split.

Defined cases: null texts count as empty and are equal to one another and to
texts of white space alone; rows of the same text, length and id are tied, and
one of them stays; null ids lose against any id of the same length; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, id_text, written

SLOTS = 4
KICKS = 200
#: Digests a bucket is planned for; the number of buckets follows the input.
BUCKET_ROWS = 200_000
_NONE = 0xFFFFFFFF


class CuckooIndex:
    """Cuckoo filter over stored keys (32-byte digests) with a count and a value each.

    ``prints`` has 4 fingerprints a bucket (0: free) and ``refs`` the number of
    the stored key behind each."""

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.counts: list[int] = []
        self.values: list = []
        self.free: list[int] = []
        self.resizes = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * buckets * SLOTS))
        self.refs = array("I", [_NONE]) * (buckets * SLOTS)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        where, mark = struct.unpack_from("<QH", key)
        mark = mark or 1
        first = where & self.mask
        return mark, first, first ^ self._other(mark)

    def _other(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 7) & self.mask

    def find(self, key: bytes) -> int:
        """Number of the stored key, or -1. Only fingerprint hits look at keys."""
        mark, one, two = self._places(key)
        for bucket in (one, two) if one != two else (one,):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[at] == mark and self.keys[self.refs[at]] == key:
                    return self.refs[at]
        return -1

    def _place(self, key: bytes, ref: int) -> bool:
        mark, bucket, two = self._places(key)
        for b in (bucket, two):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.refs[at] = mark, ref
                    return True
        for kick in range(KICKS):
            at = bucket * SLOTS + (ref + kick) % SLOTS
            mark, self.prints[at] = self.prints[at], mark
            ref, self.refs[at] = self.refs[at], ref
            bucket ^= self._other(mark)
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.refs[at] = mark, ref
                    return True
        return False

    def _resize(self) -> None:
        """Double the table until all stored keys find a place.

        Equal fingerprints and places of over 8 keys would never fit; SHA-256
        digests make that practically impossible, and it raises."""
        buckets = (self.mask + 1) * 2
        while True:
            if buckets > 64 * (len(self.keys) + 64):
                raise RuntimeError("digests are not spread: over 8 keys share all their filter bits")
            self._empty(buckets)
            self.resizes += 1
            if all(self._place(k, i) for i, k in enumerate(self.keys) if k is not None):
                return
            buckets *= 2

    def insert(self, key: bytes, count: int = 1, value=None) -> int:
        """Add to a live digest's count, or store it as new; gives its number."""
        ref = self.find(key)
        if ref >= 0:
            self.counts[ref] += count
            return ref
        if self.free:
            ref = self.free.pop()
            self.keys[ref], self.counts[ref], self.values[ref] = key, count, value
        else:
            ref = len(self.keys)
            self.keys.append(key)
            self.counts.append(count)
            self.values.append(value)
        if not self._place(key, ref):
            self._resize()
        return ref

    def delete(self, key: bytes, count: int = 1) -> bool:
        """Take from a digest's count; at zero it leaves the filter. False: it isn't live."""
        ref = self.find(key)
        if ref < 0:
            return False
        self.counts[ref] -= count
        if self.counts[ref] <= 0:
            mark, one, two = self._places(key)
            for bucket in (one, two):
                for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                    if self.prints[at] and self.refs[at] == ref:
                        self.prints[at], self.refs[at] = 0, _NONE
            self.keys[ref], self.values[ref] = None, None
            self.free.append(ref)
        return True

    def live(self) -> Iterator[tuple[bytes, int, object]]:
        return ((k, c, v) for k, c, v in zip(self.keys, self.counts, self.values) if k is not None)


ROWS = "doc_id long, n_points long, digest binary"
MERGED = "digest binary, n long, n_points long, doc_id long, tag long"


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_points (code points of the text), digest of the text without white space."""
    blanks = BLANKS.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [hashlib.sha256(t.as_py().translate(None, blanks)).digest() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary())],
                                             names=["doc_id", "n_points", "digest"])

    return (id_text(docs, id_col, text_col)
            .select("doc_id", F.length("text").cast("long").alias("n_points"), F.col("text").cast("binary"))
            .mapInArrow(run, ROWS))


def _rank(points: int, doc: int | None, tag: int) -> tuple:
    return -points, doc is None, doc or 0, tag


def _merge(limit: int | None):
    """Equal digests -> one row with their count and the row that stays.
    ``limit``: rows are handed on early when so many digests are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()

        def out() -> pa.RecordBatch:
            rows = list(index.live())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([-r[2][0] for r in rows], pa.int64()),
                 pa.array([None if r[2][1] else r[2][2] for r in rows], pa.int64()),
                 pa.array([r[2][3] for r in rows], pa.int64())], names=["digest", "n", "n_points", "doc_id", "tag"])

        for b in batches:
            for digest, n, points, doc, tag in zip(*(c.to_pylist() for c in b.columns)):
                rank = _rank(points, doc, tag)
                ref = index.insert(digest, n, rank)
                if rank < index.values[ref]:
                    index.values[ref] = rank
            if limit and len(index) > limit:
                yield out()
                index = CuckooIndex()
        if len(index):
            yield out()
    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points, then the smallest id, stays."""
    rows = written(digest_rows(docs, id_col, text_col).withColumn("tag", F.monotonically_increasing_id()), "digests")
    buckets = max(1, -(-rows.count() // bucket_rows))
    buckets = max(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = written(
        rows.select("digest", F.lit(1).cast("long").alias("n"), "n_points", "doc_id", "tag")
        .mapInArrow(_merge(bucket_rows), MERGED)
        .repartition(buckets, "digest").mapInArrow(_merge(None), MERGED), "digest-groups")
    many = groups.filter("n > 1").select("digest", F.col("n").alias("group_size"), F.col("doc_id").alias("keep_id"),
                                         F.col("tag").alias("keep_tag"))
    return (rows.join(many, "digest", "left")
            .select("doc_id",
                    F.when(F.col("keep_tag").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    F.coalesce(F.col("tag") == F.col("keep_tag"), F.lit(True)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


INDEX = "bucket int, keys array<binary>, counts array<long>"


def build_index(spark: SparkSession, digests: DataFrame, buckets: int) -> DataFrame:
    """The index of a digest table as rows (bucket, keys, counts), ready to be written."""
    return update_index(spark.createDataFrame([], INDEX), digests, digests.limit(0), buckets)


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, buckets: int) -> DataFrame:
    """Apply live insertions and deletions (tables with a ``digest`` column) to
    an index; every bucket is loaded into a cuckoo filter and changed there.
    Deleting what isn't live does nothing."""
    def change(df: DataFrame, sign: int) -> DataFrame:
        # equal digests merge in each map task first
        return (df.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
                .select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), "digest",
                        (F.col("n") * sign).alias("n")))

    changes = change(inserts, 1).unionByName(change(deletes, -1))

    def run(key, old: pa.Table, new: pa.Table) -> pa.Table:
        cuckoo = CuckooIndex()
        for keys, counts in zip(old["keys"].to_pylist(), old["counts"].to_pylist()):
            for k, n in zip(keys, counts):
                cuckoo.insert(k, n)
        for k, n in sorted(zip(new["digest"].to_pylist(), new["n"].to_pylist()), key=lambda x: -x[1]):
            cuckoo.insert(k, n) if n > 0 else cuckoo.delete(k, -n)
        rows = sorted(cuckoo.live())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([[r[0] for r in rows]], pa.list_(pa.binary())),
                         pa.array([[r[1] for r in rows]], pa.list_(pa.int64()))], names=["bucket", "keys", "counts"])

    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInArrow(run, INDEX)


def probe_index(index: DataFrame, digests: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests of a table with ``live``: whether the index holds them."""
    asked = digests.select("digest").distinct().withColumn(
        "bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))

    def run(key, old: pa.Table, new: pa.Table) -> pa.Table:
        cuckoo = CuckooIndex()
        for keys in old["keys"].to_pylist():
            for k in keys:
                cuckoo.insert(k)
        asked = new["digest"].to_pylist()
        return pa.table([pa.array(asked, pa.binary()), pa.array([cuckoo.find(k) >= 0 for k in asked], pa.bool_())],
                        names=["digest", "live"])

    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, "digest binary, live boolean")
