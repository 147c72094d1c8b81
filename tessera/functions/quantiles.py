"""Exact order statistics and quantiles of whole columns, without gathering one.

Spark's exact ``percentile`` keeps a value->count map per group in one
aggregation buffer; for a continuous column over a whole table that buffer
*is* the column, merged in one task. Here ranks are found by cutting brackets of
the value range into equal parts, counting in Arrow batches (``_table_ranks``).
The driver keeps only a few numbers per (column, rank). Quantiles per group are
in ``ranking``."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a group up to which a built-in percentile may hold its values.
BAND_LIMIT = 200_000


def _num_sql(df: DataFrame, name: str) -> str:
    """SQL text of :func:`num`: the column as double, NaN as NULL."""
    q = "`" + name.replace("`", "``") + "`"
    dt = df.schema[name].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return f"nanvl(CAST({q} AS DOUBLE), CAST(NULL AS DOUBLE))"
    return f"CAST({q} AS DOUBLE)"


def _ranks(n: int, probs) -> list[int]:
    out = []
    for p in probs:
        h = (n - 1) * p
        k1 = int(math.floor(h))
        out += [k1, min(k1 + 1, n - 1)]
    return out


#: Equal parts that a bracket is cut into in one pass.
BINS = 4096


def _keys(v: np.ndarray) -> np.ndarray:
    """Doubles -> whole numbers of the same order (and back, for such numbers)."""
    bits = v.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _bin_counts(brackets: list[list[tuple[int, int]]]):
    """Per task, for every bracket (first key, last key) of every column: rows,
    least and greatest key of each occupied part."""
    def run(batches):
        parts = []
        for c, some in enumerate(brackets):
            for j, (lo, hi) in enumerate(some):
                step = (hi - lo) // BINS + 1
                parts.append((c, j, lo, hi, step, np.zeros(BINS, np.int64), np.full(BINS, np.iinfo(np.int64).max),
                              np.full(BINS, np.iinfo(np.int64).min)))
        for b in batches:
            sorted_keys: dict[int, np.ndarray] = {}
            for c, _, lo, hi, step, n, least, most in parts:
                if c not in sorted_keys:
                    v = b.column(c).drop_null().to_numpy(zero_copy_only=False) + 0.0
                    sorted_keys[c] = np.sort(_keys(v[~np.isnan(v)]))
                keys = sorted_keys[c]
                sub = keys[np.searchsorted(keys, lo, "left"):np.searchsorted(keys, hi, "right")]
                if len(sub):
                    at = ((sub.astype(np.uint64) - np.uint64(lo % (1 << 64))) // np.uint64(step)).astype(np.int64)
                    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    end = np.concatenate([cut[1:], [len(sub)]])
                    where = at[cut]
                    n[where] += end - cut
                    least[where] = np.minimum(least[where], sub[cut])
                    most[where] = np.maximum(most[where], sub[end - 1])
        for c, j, _, _, _, n, least, most in parts:
            on = np.flatnonzero(n)
            if len(on):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(on), c, np.int32)), pa.array(np.full(len(on), j, np.int32)), pa.array(on.astype(np.int32)),
                     pa.array(n[on]), pa.array(least[on]), pa.array(most[on])], names=["c", "j", "b", "n", "lo", "hi"])
    return run


def _table_ranks(df: DataFrame, cols: list[str], ranks: dict[int, set[int]], ends: list[tuple]) -> dict[tuple[int, int], float]:
    """(column number, rank) -> value, for ranks over the whole table, of which
    ``ends`` has each column's least and greatest value.

    Every pass cuts each column's brackets into BINS parts of equal key width and
    goes on in the part that holds the rank, between its least and greatest key;
    a part with one value is the answer. A pass divides a bracket's width by BINS,
    so six passes settle any double; a value's number of copies doesn't matter."""
    data = df.select(*[F.expr(_num_sql(df, c)).alias(f"v{i}") for i, c in enumerate(cols)])
    first = {c: tuple(int(k) for k in _keys(np.array(ends[c], float) + 0.0)) for c, r in ranks.items() if r}
    open_ = {c: {first[c]: (0, sorted(r))} for c, r in ranks.items() if r}
    out: dict[tuple[int, int], float] = {}
    while open_:
        listed = [list(open_.get(c, {})) for c in range(len(cols))]
        got: dict[tuple[int, int], list] = {}
        rows = (data.mapInArrow(_bin_counts(listed), "c int, j int, b int, n long, lo long, hi long")
                .groupBy("c", "j", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
        for r in rows:
            got.setdefault((r["c"], r["j"]), []).append(r)
        nxt: dict[int, dict] = {}
        for c, some in enumerate(listed):
            for j, bracket in enumerate(some):
                below, wanted = open_[c][bracket]
                for r in sorted(got.get((c, j), []), key=lambda r: r["b"]):
                    here = [k for k in wanted if below <= k < below + r["n"]]
                    if here and r["lo"] == r["hi"]:
                        value = float(_keys(np.array([r["lo"]], np.int64).view(np.float64)).view(np.float64)[0])
                        out.update({(c, k): value for k in here})
                    elif here:
                        nxt.setdefault(c, {})[(r["lo"], r["hi"])] = (below, here)
                    below += r["n"]
        open_ = nxt
    return out


def _table_quantiles(df: DataFrame, cols: list[str], probs: list[float], extra_aggs, ranks_fn):
    """``quantile_values`` without groups."""
    row = df.agg(*(extra_aggs or []), *[F.expr(f"{f}({_num_sql(df, c)})").alias(f"__{a}_{i}") for i, c in enumerate(cols)
                                        for f, a in (("count", "n"), ("min", "lo"), ("max", "hi"))]).first()
    counts = [row[f"__n_{i}"] for i in range(len(cols))]
    ends = [(row[f"__lo_{i}"], row[f"__hi_{i}"]) for i in range(len(cols))]
    if ranks_fn is not None:
        asked = ranks_fn((), cols[0], counts[0])
        found = _table_ranks(df, cols, {0: {k for k in asked if k is not None}}, ends)
        return {(): [None if k is None else found[(0, k)] for k in asked]}, {(): row}
    found = _table_ranks(df, cols, {i: set(_ranks(n, probs)) for i, n in enumerate(counts) if n and probs}, ends)
    out = {}
    for i, c in enumerate(cols):
        for p in probs:
            if not counts[i]:
                out[(c, p)] = None
                continue
            k, _ = _ranks(counts[i], [p])
            w = (counts[i] - 1) * p - k
            v1, v2 = (found[(i, r)] for r in _ranks(counts[i], [p]))
            out[(c, p)] = v1 if w == 0 or v1 == v2 else v1 + w * (v2 - v1)
    return {(): out}, {(): row}


def quantile_values(df: DataFrame, cols: list[str], probs: list[float], extra_aggs: list[Column] | None = None, ranks_fn=None):
    """Exact linear-interpolated quantiles (pandas / ``quantile_cont``
    semantics) of each column over the whole table.

    Returns ``(values, extras)``: ``values[()][(column, p)] -> float|None``
    and ``extras[()] -> Row`` holding ``extra_aggs`` (evaluated in the same
    first scan) plus ``__n_<column>`` counts."""
    return _table_quantiles(df, cols, probs, extra_aggs, ranks_fn)


def kth_values(df: DataFrame, column: str, ranks_fn, extra_aggs: list[Column] | None = None):
    """Exact values at 0-based ranks (ascending, NULLs excluded) of one
    column: ``ranks_fn(key, column, n) -> [rank, ...]``.
    Returns ``({(): [value, ...]}, extras)``."""
    return quantile_values(df, [column], [], extra_aggs, ranks_fn=ranks_fn)
