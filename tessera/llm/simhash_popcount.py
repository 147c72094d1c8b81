"""SimHash near-duplicates, linked through a segment-popcount embedding.

A fingerprint's 64 bits are cut into 16 segments; the vector of the segments'
bit counts embeds it in a grid, and the Manhattan distance of two vectors is
never above the Hamming distance of the fingerprints. Fingerprints within 2
bits therefore lie within Manhattan distance 2 and have a grid cell in common
that is at most one step away from both: every distinct fingerprint is entered
in its own cell and the cells one step up or down, fingerprints that meet in a
cell are candidates, and their bits are compared.

A cell where more than ``PAIRS_UP_TO`` fingerprints meet (families of near
copies) is not paired up. Its fingerprints are entered under themselves and
their 64 one-bit neighbours instead: two of them differ in at most 2 bits
exactly if they share such an entry, an entry has at most 65 fingerprints, and
one link to the least of them joins them all. Work stays in proportion to the
rows, and no link between components is lost.

Defined cases: a null text counts as empty; texts without words have
fingerprint zero and link as any other; rows with the same text share a
fingerprint, whatever their ids; ids that are null never become a component's
id unless it has no other (then it is null); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_text, written
from tessera.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
PAIRS_UP_TO = 32
#: Shingles whose bits are summed at a time in a task.
SUM_AT_ONCE = 100_000


def _majority(hashes: list[list[int]]) -> np.ndarray:
    """One fingerprint a document from the documents' shingle hashes."""
    out = np.zeros(len(hashes), np.uint64)
    lens = np.array([len(h) for h in hashes])
    some = np.flatnonzero(lens)
    if not len(some):
        return out
    flat = np.array([x for h in hashes for x in h], dtype="<u8")
    starts = np.concatenate([[0], np.cumsum(lens[some])[:-1]])
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    major = np.packbits(2 * counts > lens[some, None], axis=1, bitorder="little")
    out[some] = np.ascontiguousarray(major).view("<u8").reshape(-1)
    return out


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh

        for b in batches:
            found, hashes, held = [], [], 0
            for t in b.column(1):
                words = t.as_py().lower().split()  # of bytes: ASCII case and the six white-space bytes
                if len(words) <= shingle:
                    hashes.append([xxh(b" ".join(words), SEED)] if words else [])
                else:
                    joined, ends, at = b" ".join(words), [], -1
                    for w in words:
                        at += len(w) + 1
                        ends.append(at)
                    starts = [0, *[e + 1 for e in ends[:-shingle]]]
                    hashes.append([xxh(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:])])
                held += len(hashes[-1])
                if held > SUM_AT_ONCE:
                    found.append(_majority(hashes))
                    hashes, held = [], 0
            found.append(_majority(hashes))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(np.concatenate(found).view(np.int64))],
                                             names=["doc_id", *b.schema.names[2:], "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the 64-bit SimHash of a text's word shingles as a long."""
    return (id_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary"))
            .mapInArrow(_fingerprints(shingle), "doc_id long, fp long"))


def embedding(fp: str) -> list[Column]:
    """The bit counts of the segments."""
    return [F.bit_count(F.shiftrightunsigned(F.col(fp), WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int"))
            .cast("long") for i in range(SEGMENTS)]


def _meeting_cells(fps: DataFrame) -> DataFrame:
    """cell, fp, kind: own cell (0), cells a step up (1) or down (2). A vector
    is packed with 3 bits a segment, so a step is a constant."""
    counts = embedding("fp")
    own = counts[0]
    for i in range(1, SEGMENTS):
        own = own + F.shiftleft(counts[i], 3 * i)
    entries = [F.struct(F.col("own").alias("cell"), F.lit(0).alias("kind"))]
    for i in range(SEGMENTS):
        here = F.shiftright("own", 3 * i).bitwiseAND(F.lit(7))
        # outside 0..WIDTH there is no vector, and no half-way cell either
        entries.append(F.when(here < WIDTH, F.struct((F.col("own") + (1 << 3 * i)).alias("cell"), F.lit(1).alias("kind"))))
        entries.append(F.when(here > 0, F.struct((F.col("own") - (1 << 3 * i)).alias("cell"), F.lit(2).alias("kind"))))
    return (fps.select("fp", own.alias("own"))
            .select("fp", "own", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
            .select(F.col("e.cell").alias("cell"), F.col("e.kind").alias("kind"), "own", "fp"))


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links that connect exactly the distinct fingerprints ``fps``
    (column fp) within 2 bits of one another, directly or through others."""
    entered = _meeting_cells(fps)
    # a merge join: Spark sizes the cells as if each fingerprint had one entry, and would broadcast them
    counted = entered.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").hint("merge")
    met = written(entered.join(counted, "cell"), "met")
    groups = met.filter(F.col("n") <= PAIRS_UP_TO).groupBy("cell").agg(F.collect_list(F.struct("kind", "own", "fp")).alias("g"))
    # which kinds may meet: equal vectors (0, 0), one step apart (0, 1), two steps
    # apart (1, 1) or (1, 2); other meetings repeat these
    pairs = F.flatten(F.transform("g", lambda a: F.transform(
        F.filter("g", lambda b: (a["fp"] != b["fp"]) & _close(a["fp"], b["fp"]) & (
            ((a["kind"] == 0) & (b["kind"] == 0) & (a["fp"] < b["fp"])) | ((a["kind"] == 0) & (b["kind"] == 1))
            | ((a["kind"] == 1) & (b["kind"] == 1) & (a["own"] < b["own"])) | ((a["kind"] == 1) & (b["kind"] == 2) & (a["own"] != b["own"])))),
        lambda b: F.struct(a["fp"].alias("u"), b["fp"].alias("v")))))
    near = groups.select(F.explode(pairs).alias("e")).select("e.u", "e.v")
    crowd = met.filter(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)]
    shared = (crowd.select("fp", F.explode(F.array(*flips)).alias("entry"))
              .groupBy("entry").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("vs")).filter(F.size("vs") > 1))
    hung = shared.select("u", F.explode("vs").alias("v")).filter("u != v")
    return near.union(hung).distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest id that links reach."""
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fps")
    member = components(links(distinct)).withColumnRenamed("node", "fp")
    least = (member.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("component")))
    linked = member.join(least, "root").select("fp", "component", "root")
    # written, so that the last join is a plain one of two shuffles that can be split where a fingerprint is hot
    of_fp = written(distinct.join(linked, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component")).alias("component_id")), "fp-groups")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def fp_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one of the
    smallest id (null ids last), of several such rows the one read first. A
    row number tells rows apart, so rows without an id, or with an id that
    occurs again, go only if they are linked to the staying one."""
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    ids = numbered.select(numbered[id_col].cast("long").alias("doc_id"),
                          F.coalesce(numbered[text_col].cast("string"), F.lit("")).cast("binary").alias("text"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    # a row a fingerprint is left of a family of copies before anything is shuffled
    distinct = written(ids.mapInArrow(_fingerprints(shingle), "doc_id long, row long, fp long").groupBy("fp").agg(first), "distinct-fps")
    member = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    stay = (distinct.join(member, "fp", "left").groupBy(F.coalesce("root", "fp").alias("component"))
            .agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)))
    return numbered.join(stay, row, "left_semi").select(*[numbered[c] for c in docs.columns])
