"""Runs of words that repeat with a period, by an online sparse diagonal DP.

Words ``i`` and ``i - q`` that are equal lie on diagonal (lag) ``q`` of the
text's comparison with itself. Reading on, a word's earlier occurrences each
lengthen the match on their lag; a lag whose words differ ends, and a match that
was long enough is a run at that moment. Two exact rules keep the set of active
lags sparse, so that a text of ``n`` words takes about ``n log n`` steps however
it repeats:

* A run of period ``q`` needs ``3q`` matches in a row. A lag in [2^t, 2^(t+1))
  therefore starts only where the next ``3 * 2^t`` words (gram) occur earlier at
  that lag, preceded by another word. Grams longer than the lag cannot overlap
  freely, so few starts remain. Grams are numbered by doubling (rank pairs),
  which compares words, not hashes.
* A lag is left out while a lag that divides it is active over the same words:
  the two match and end together, and the longer is not the smallest period.

A run is (start, length, period) in words: ``period`` is its smallest, ``length >=
max(min_words, min_periods * period)``, and no neighbouring word extends it.

Each document is one row of a map without shuffle; its words and their grams
are what a task holds. Defined cases: a null or empty text has no runs; every
row gives a row, whatever its id; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_text

MIN_WORDS = 6
MIN_PERIODS = 4

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs (a, b), both below 2^31."""
    return np.unique(a * np.int64(1 << 31) + b, return_inverse=True)[1]


def _starts(words: np.ndarray, min_periods: int) -> dict[int, list[int]]:
    """Position -> lags whose diagonal starts there and can become a run."""
    n, out = len(words), defaultdict(list)
    same = words[1:] == words[:-1]
    for i in np.flatnonzero(same & ~np.concatenate([[False], same[:-1]])) + 1:
        out[int(i)].append(1)
    # grams of 3 words at `at`; positions whose gram occurs once are left out
    if n < 8:
        return out
    at = np.arange(n - 2)
    gram = _ranks(_ranks(words[:-2], words[1:-1]), words[2:])
    size, low = 3, 2
    while low * min_periods <= n and len(at):
        # grams of 3 * low words: two of half the size, one after the other
        where = np.searchsorted(at, at + size)
        ok = where < len(at)
        ok[ok] = at[where[ok]] == at[ok] + size
        at, gram = at[ok], _ranks(gram[ok], gram[where[ok]])
        size = 2 * size
        many = np.bincount(gram, minlength=1)[gram] > 1 if len(at) else np.zeros(0, bool)
        at, gram = at[many], gram[many]
        order = np.lexsort((at, gram))
        p, g = at[order], gram[order]
        near = np.zeros(len(p), bool)
        near[1:] = (g[1:] == g[:-1]) & (p[1:] - p[:-1] < 2 * low)
        if near.any():
            _pairs(words, p, near, low, out)
        low *= 2
    return out


def _pairs(words: np.ndarray, p: np.ndarray, near: np.ndarray, low: int, out: dict) -> None:
    """Starts with a lag in [low, 2 low): occurrences ``p`` of one gram, in order
    and near one another, are held as blocks of one word before; a block of the
    word that stands before the gram here continues a diagonal, and is passed over."""
    before = np.where(p > 0, words[p - 1], -1)
    blocks: list[tuple[int, list[int]]] = []
    touched = np.flatnonzero(near | np.concatenate([near[1:], [False]]))
    for k in touched.tolist():
        i, w = int(p[k]), int(before[k])
        if not near[k]:
            blocks = []
        for other, places in reversed(blocks):
            if i - places[-1] >= 2 * low:
                break
            if other == w:
                continue
            for j in reversed(places):
                if i - j >= 2 * low:
                    break
                if i - j >= low:
                    out[i].append(i - j)
        if blocks and blocks[-1][0] == w:
            blocks[-1][1].append(i)
        else:
            blocks.append((w, [i]))


def _smallest(words: np.ndarray, start: int, end: int, q: int) -> bool:
    """Is ``q`` the smallest period of words[start:end], which has at least 4q words?
    A smaller one would divide it (two periods of so long a stretch share their
    greatest common divisor), so only q over a prime has to be tried."""
    rest, prime = q, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            p = q // prime
            if np.array_equal(words[start:end - p], words[start + p:end]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def runs_of(words: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text of word numbers, by start, then period."""
    if min_periods < 4:
        raise ValueError("runs have at least four periods")
    starts = _starts(words, min_periods)
    if not starts:
        return []
    found: list[tuple[int, int, int]] = []
    w, n = words.tolist(), len(words)
    active: dict[int, int] = {}  # lag -> matches in a row so far
    todo = sorted(starts)
    k, i = 0, todo[0]

    def end(q: int, m: int, i: int) -> None:
        if m + q >= max(min_words, min_periods * q) and _smallest(words, i - m - q, i, q):
            found.append((i - m - q, m + q, q))

    while i < n:
        for q, m in list(active.items()):
            if w[i] == w[i - q]:
                active[q] = m + 1
            else:
                end(q, m, i)
                del active[q]
        if k < len(todo) and todo[k] == i:
            for q in sorted(starts[i]):
                if q not in active and not any(q % p == 0 and active[p] + p >= 1 + q for p in active):
                    active[q] = 1
            k += 1
        if active:
            i += 1
        elif k < len(todo):
            i = todo[k]
        else:
            break
    for q, m in active.items():
        end(q, m, n)
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words outside runs and in the first period of every run that holds them."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


#: (id, number of words) -> the words' places in the original text, or None for the text as it is.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def _scan(rewrite: Rewrite | None, min_words: int, min_periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number: dict[bytes, int] = defaultdict(count().__next__)
            ids, n_words, runs, collapsed = batch.column(0), [], [], []
            for doc, text in zip(ids.to_pylist(), batch.column(1).cast(pa.binary())):
                words = text.as_py().split()  # of bytes: at blanks and bytes 9 to 13
                places = rewrite(doc, len(words)) if rewrite else None
                if places is not None:
                    words = [words[j] for j in places.tolist()]
                at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                found = runs_of(at, min_words, min_periods)
                if found:
                    words = [words[j] for j in np.flatnonzero(kept_words(len(words), found)).tolist()]
                n_words.append(len(at))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary())],
                names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None, min_words: int = MIN_WORDS,
              min_periods: int = MIN_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, its runs by start, then period, and
    ``collapsed``: its words joined by a blank, each run cut to its first period.
    ``rewrite`` may rearrange a document's words before they are read."""
    return (id_text(docs, id_col, text_col)
            .mapInArrow(_scan(rewrite, min_words, min_periods), f"doc_id long, n_words long, runs {RUNS}, collapsed binary")
            .withColumn("collapsed", F.decode("collapsed", "utf-8")))


def strongest() -> Column:
    """The run of greatest length over period (exact; ties: first start, then period)."""
    def before(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(x > y, -1).when(x < y, 1).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(
            a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1)).otherwise(0)
    return F.get(F.array_sort("runs", before), F.lit(0))


def runs_sha256() -> Column:
    """Digest of the lines start,length,period."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)


def planted_periods(doc: int | None, n: int) -> np.ndarray | None:
    """The query's rewriting: of ids whose crc32 ends in 0, the words from a place
    on repeat with a period; both follow from the crc32. Rows without id stay."""
    if doc is None or n == 0:
        return None
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)
