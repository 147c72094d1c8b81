"""Document scores by masked pseudo-likelihood.

A small network predicts every word from the two words on either side: the four
context words' embeddings (one table, with a scale for each position) are added,
pass a tanh layer, and a two-step softmax gives the word's class and the word
within its class, so that probabilities add up to one. The sum of the words' conditional log
probabilities is the document's score.

What is gathered from the corpus: the counts of all words, and the networks of
trainers, each trained in numpy on all documents of its scan splits with every
position as a target once, in batches of shuffled stretches of ``SPAN`` places.
There are as many trainers as the corpus holds networks (by bytes), so that what
they write follows the input whatever the number of splits. The most frequent words are leaves of the two-step softmax. All
others share its remaining leaves (buckets) by hash, and a third step, a binary
tree below each bucket, leads to the word: every word that occurs ``MIN_COUNT``
times has a leaf and embeddings of its own, but no more words than ``OWN`` times
the cube root of the corpus' words (the most frequent): that bounds what the
driver and every task hold. The rarer ones of a bucket share a leaf, whose
probability is multiplied by the word's share of their counts. So scores are of
words, and vocabulary and network grow with the input. The trainers' rows of the
words' tables are averaged by how often each was met, the rest by tokens, in a
tree of groups of ``FAN``; the counts of the rarer words stay a distributed table.

Defined cases: null and empty texts have no words, log_prob 0 and mean 0; words
at a text's ends see a padding word; rows with one id are scored one by one; an
empty table gives an empty result; other columns are ignored; a long text is
scored in pieces of fixed size, which changes nothing.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_text, written
from tessera.llm.fm_decontam import _WORDS, words_of

CLASSES = 32
VOCAB = CLASSES * CLASSES
#: Leaves of the two-step softmax that words share by hash.
HASHED = VOCAB // 2
HIDDEN = 16
OFFSETS = (-2, -1, 1, 2)
#: Words that occur so often have a leaf and embeddings of their own, up to OWN
#: times the cube root of all words: 0.2 million of 10^8, 10 million of 10^13.
MIN_COUNT = 20
OWN = 400
#: Neighbouring places that are targets together, and such stretches a step.
SPAN = 64
SPANS = 128
RATE = 0.3
SEED = 42
_ONES = np.ones(CLASSES, np.float32)
FAN = 16
#: Words scored at a time, and bytes of text prepared at a time, in a task.
PIECE = 16_384
GROUP_BYTES = 2_000_000
#: Such groups of texts whose words are looked up together.
GROUPS = 4
#: Distinct words that a task counts before it hands them on.
COUNTED = 500_000
#: Up to so many rows of one id are added one after the other, more as a segment.
ROUNDS = 4
#: Words whose rows are averaged at a time, and bytes that a written row takes.
BLOCK = 4096
ROW_BYTES = 2 * (2 * HIDDEN + 1) + 4 + 8


class Words(list):
    """Words with ids of their own, the most frequent first; their counts, and
    the counts of all other words by bucket."""

    def __init__(self, words=(), counts=None, rest=None):
        super().__init__(words)
        self.counts = np.ones(len(self)) if counts is None else counts
        self.rest = np.ones(HASHED) if rest is None else rest


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % HASHED


class Tree:
    """Below each bucket a binary (Huffman) tree over its own words and a leaf
    for all others. Leaf j is the j-th word that has no id below VOCAB, leaf
    ``size`` + b the others of bucket b; a leaf's path is node[start[leaf]:start[leaf + 1]],
    with ``right`` telling where it goes. ``odds`` are the counts' log odds."""

    def __init__(self, words: list[bytes]):
        words = words if isinstance(words, Words) else Words(words)
        tail = words[VOCAB - HASHED:]
        counts = words.counts[VOCAB - HASHED:]
        self.size = len(tail)
        self.top = np.array([VOCAB - HASHED + _bucket(w) for w in tail], np.int32)
        members: dict[int, list[int]] = {}
        for j, t in enumerate(self.top.tolist()):
            members.setdefault(t - (VOCAB - HASHED), []).append(j)
        self.top_of = np.concatenate([np.arange(VOCAB + 1), self.top]).astype(np.int16)
        self.odds = np.zeros(self.size, np.float32)
        paths: list[list[tuple[int, bool]]] = [[] for _ in range(self.size + HASHED)]
        at = 0
        for b, js in members.items():
            heap = [(max(float(words.rest[b]), 0.5), self.size + b, None)] + [(float(counts[j]), j, None) for j in js]
            heapq.heapify(heap)
            made = len(paths)
            while len(heap) > 1:
                left, right = heapq.heappop(heap), heapq.heappop(heap)
                self.odds[at] = np.log(right[0] / left[0])
                heapq.heappush(heap, (left[0] + right[0], made, (at, left, right)))
                at, made = at + 1, made + 1
            todo = [(heap[0], [])]
            while todo:
                (_, leaf, inner), path = todo.pop()
                if inner is None:
                    paths[leaf] = path
                else:
                    todo += [(inner[1], [*path, (inner[0], False)]), (inner[2], [*path, (inner[0], True)])]
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)
        self.node = np.array([n for p in paths for n, _ in p], np.int32)
        self.right = np.array([r for p in paths for _, r in p], bool)

    def leaves(self, ids: np.ndarray) -> np.ndarray:
        """Of target ids; -1 for words that the two-step softmax settles."""
        return np.where(ids > VOCAB, ids - (VOCAB + 1), np.where(ids >= VOCAB - HASHED, ids - (VOCAB - HASHED) + self.size, -1))

    def tops(self, ids: np.ndarray) -> np.ndarray:
        """The ids' leaves in the two-step softmax."""
        return self.top_of.take(ids)

    def by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids' order by class; in this order their classes and places in
        them; where a class starts."""
        top = self.tops(ids)
        cls = top // np.int16(CLASSES)
        # numpy sorts numbers of 16 bits by radix
        order = np.argsort(cls, kind="stable")
        cls = cls.take(order)
        return order, cls, top.take(order) - cls * np.int16(CLASSES), np.searchsorted(cls, np.arange(CLASSES + 1))

    def below(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ids have a leaf, those of a bucket side by side, as its nodes are; the leaves."""
        leaves = self.leaves(ids)
        some = np.flatnonzero(leaves >= 0)
        some = some[np.argsort(self.tops(ids[some]), kind="stable")]
        return some, leaves[some]


class Vocabulary(dict):
    """Word -> id: below VOCAB - HASHED or above VOCAB its own, else its bucket's."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, [*range(min(len(words), VOCAB - HASHED)), *range(VOCAB + 1, len(words) + HASHED + 1)]))
        self.own = len(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.own + 200_000:
            for w in list(self)[self.own:]:
                del self[w]
        out = self[word] = VOCAB - HASHED + _bucket(word)
        return out

    def ids(self, text: bytes) -> np.ndarray:
        return self.of(words_of(text))

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def coded(self, groups: list[list[bytes]]) -> Iterator[tuple[list[np.ndarray], np.ndarray, pa.Array]]:
        """Of each group the ids of every text, and all words as places in an
        array, and that array. A distinct word is looked up once for all groups."""
        codes, words, ends = coded(groups)
        listed = words.to_numpy(zero_copy_only=False).tolist()
        of = np.fromiter(map(self.get, listed, repeat(-1)), np.int32, len(listed))
        shared = np.flatnonzero(of < 0)
        of[shared] = [VOCAB - HASHED + _bucket(listed[i]) for i in shared.tolist()]
        for some, end in zip(codes, ends):
            ids, end = of.take(some), end.tolist()
            yield [ids[a:b] for a, b in zip([0, *end], end)], some, words


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (those of ``words_of``) in one array, and where each text's words end."""
    text = b"".join([b" ", b" ".join(texts), b" "]).lower().translate(_WORDS)
    inside = np.frombuffer(text, np.uint8) != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(edges[1::2] - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text.translate(None, b" "))])
    return words, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))


def coded(groups: list[list[bytes]]) -> tuple[list[np.ndarray], pa.Array, list[np.ndarray]]:
    """The words of each group of texts as places in an array of the distinct
    ones; that array; where each text's words end in its group."""
    words, ends = zip(*map(split, groups))
    # arrays without words have no chunk
    chunks = pa.chunked_array(words).dictionary_encode().chunks
    codes = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in chunks)])
    upto = np.cumsum([0, *map(len, words)]).tolist()
    return [codes[a:b] for a, b in zip(upto, upto[1:])], chunks[-1].dictionary if chunks else words[0], list(ends)


def _merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]) if parts else _NO_COUNTS


_NO_COUNTS = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[pa.Table] = []
    for b in batches:
        for groups in _blocks(b):
            codes, words, _ = coded(groups)
            parts.append(pa.table({"word": words.cast(pa.binary()), "n": np.bincount(np.concatenate(codes), minlength=len(words))}))
            if sum(map(len, parts)) > 2 * COUNTED:
                parts = [_merged(parts)]
                if len(parts[0]) > COUNTED:
                    yield from parts.pop().to_batches(100_000)
    yield from _merged(parts).to_batches(100_000)


def count_words(rows: DataFrame) -> DataFrame:
    """word, n of all texts (doc_id, text as binary), written."""
    return written(rows.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(rows: DataFrame, counts: DataFrame | None = None) -> Words:
    """The most frequent words, and all that occur MIN_COUNT times, or the count
    from which on they are at most OWN times the cube root of all words."""
    counts = count_words(rows) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    ordered = counts.orderBy(F.desc("n"), "word")
    got = ordered.filter(F.col("n") >= own_count(counts, int(OWN * total ** (1 / 3)))).toArrow()
    if got.num_rows < VOCAB - HASHED:
        got = ordered.limit(VOCAB - HASHED).toArrow()
    words, n = [bytes(w) for w in got["word"].to_pylist()], np.array(got["n"].to_pylist(), float)
    rest = np.zeros(HASHED)
    for b, total in counts.groupBy((F.crc32("word") % HASHED).cast("int")).agg(F.sum("n")).collect():
        rest[b] = total
    np.subtract.at(rest, np.array([_bucket(w) for w in words], np.int64), n)
    return Words(words, n, rest)


def own_count(counts: DataFrame, bound: int) -> int:
    """The smallest count, MIN_COUNT or more, that at most ``bound`` words reach."""
    least, beyond = MIN_COUNT, counts.filter(F.col("n") >= MIN_COUNT).count()
    if beyond <= bound:
        return least
    # steps of a sixteenth, so that few numbers reach the driver
    step = F.floor(F.log2("n") * 16).cast("int")
    total = 0
    for s, n in counts.filter(F.col("n") >= MIN_COUNT).groupBy(step).count().orderBy(F.desc(step)).collect():
        total += n
        if total > bound:
            return max(least, math.ceil(2 ** ((s + 1) / 16)))
    return least


def _shapes(own: int = 0) -> list[tuple[int, ...]]:
    return [(VOCAB + 1 + own, HIDDEN), (len(OFFSETS), HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, CLASSES), (CLASSES, CLASSES)]


class Network:
    """emb, scale (of a position), b0, w1, b1 (classes), w2, b2 (words within a
    class); nodes and bias of the trees below the buckets, which start from the
    words' shares."""

    def __init__(self, flat: np.ndarray | None = None, tree: Tree | None = None):
        self.tree = tree or Tree([])
        self.nodes, self.bias = np.zeros((self.tree.size, HIDDEN), np.float32), self.tree.odds.copy()
        if flat is None:
            rng = np.random.default_rng(SEED)
            self.params = [(rng.standard_normal(s) * (0.1 if len(s) > 1 else 0)).astype(np.float32) for s in _shapes(self.tree.size)]
            self.params[1] = (1 + 3 * self.params[1]).astype(np.float32)
            self.params[-1][:] = 0
        else:
            self.params, at = [], 0
            for s in _shapes(self.tree.size):
                n = int(np.prod(s))
                self.params.append(flat[at:at + n].astype(np.float32).reshape(s))
                at += n

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.params])

    def _hidden(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of stretches of ids (last axis), and the hidden layer of
        all places but two at either end."""
        emb, scale, b0 = self.params[:3]
        rows, n = emb.take(ids, axis=0), ids.shape[-1] - 4
        # a stretch is one long row, so that numpy's inner loops are long too
        beside, wide = rows.reshape(*ids.shape[:-1], -1), n * HIDDEN
        total = beside[..., :wide] * np.tile(scale[0], n)
        total += np.tile(b0, n)
        for k in range(1, len(OFFSETS)):
            at = (2 + OFFSETS[k]) * HIDDEN
            total += beside[..., at:at + wide] * np.tile(scale[k], n)
        return rows, np.tanh(total, out=total).reshape(*ids.shape[:-1], n, HIDDEN)

    def _levels(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The leaves by length of their paths, longest first; where these paths
        start; how many have a first, second, .. step."""
        start = self.tree.start[leaves]
        lens = self.tree.start[leaves + 1] - start
        order = np.argsort((-lens).astype(np.int16), kind="stable")
        return order, start[order], (len(lens) - np.cumsum(np.bincount(lens)))[:-1].tolist()

    def _level(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of a step of every path: node, direction, its log odds, the nodes' rows."""
        node = self.tree.node.take(at)
        rows = self.nodes.take(node, axis=0)
        return node, self.tree.right.take(at), np.einsum("ij,ij->i", rows, h) + self.bias.take(node), rows

    @staticmethod
    def _small(w: np.ndarray, b: np.ndarray) -> bool:
        """Whether no exponent of a hidden layer (within -1 and 1) can overflow."""
        return bool(np.abs(w).sum(axis=-2).max() + np.abs(b).max() < 60)

    @staticmethod
    def _exp(z: np.ndarray, small: bool) -> np.ndarray:
        if not small:
            z -= z.max(axis=1, keepdims=True)
        return np.exp(z, out=z)

    @staticmethod
    def _softmax(z: np.ndarray, small: bool) -> np.ndarray:
        z = Network._exp(z, small)
        z /= (z @ _ONES)[:, None]
        return z

    @staticmethod
    def _chosen(z: np.ndarray, small: bool, at: np.ndarray) -> np.ndarray:
        """One value of each row of the softmax."""
        z = Network._exp(z, small)
        return z.reshape(-1).take(np.arange(0, z.size, CLASSES) + at) / (z @ _ONES)

    def _classes(self, h: np.ndarray) -> tuple[np.ndarray, bool]:
        """Log odds of the classes, and whether they are small; h: hidden rows and a column of ones."""
        w, b = self.params[3:5]
        return h @ np.concatenate([w, b[None]]), self._small(w, b)

    def _words(self, h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, bool]:
        """Log odds of the words within the class, of rows sorted by class."""
        w, b = self.params[5:]
        both, z = np.concatenate([w, b[:, None]], axis=1), np.empty((len(h), CLASSES), np.float32)
        for c, (i, j) in enumerate(zip(cut, cut[1:])):
            if i < j:
                np.matmul(h[i:j], both[c], out=z[i:j])
        return z, self._small(w, b)

    def log_probs(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the words at ``at``, given their neighbours."""
        if not len(at):
            return np.zeros(0)
        first = at.min()
        hidden = self._hidden(_windows(padded[first - 2:at.max() + 3]))[1].reshape(-1, HIDDEN)
        deep = np.zeros(len(at))
        if self.tree.size:
            below, leaves = self.tree.below(padded[at])
            longest, start, sizes = self._levels(leaves)
            below, total = below[longest], np.zeros(len(below))
            h = hidden.take(at[below] - first, axis=0)
            for k, m in enumerate(sizes):
                _, right, z, _ = self._level(h[:m], start[:m] + k)
                z = np.where(right, -z, z)
                total[:m] -= np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0)
            deep[below] = total
        order, cls, word, cut = self.tree.by_class(padded[at])
        h = _with_ones(hidden, at[order] - first)
        p = self._chosen(*self._classes(h), cls) * self._chosen(*self._words(h, cut), word)
        out = np.empty(len(at), np.float64)
        out[order] = np.log(np.maximum(p, 1e-30))
        return out + deep

    def gradients(self, spans: np.ndarray) -> tuple[list[np.ndarray], tuple, tuple]:
        """Of the mean loss of the words of the stretches (a row: two words, SPAN
        targets, two words; padding is no target): of params[1:], and (which
        rows, how often met, gradients) of the embeddings and of the nodes."""
        rows, hidden = self._hidden(spans)
        targets = spans[:, 2:-2].ravel()
        real = np.flatnonzero(targets != VOCAB)
        order, cls, word, cut = self.tree.by_class(targets[real])
        real, n, each = real[order], np.float32(len(real)), np.arange(len(real)) * CLASSES
        h1, ids = _with_ones(hidden, real), targets[real]
        h = np.ascontiguousarray(h1[:, :HIDDEN])
        d1, d2 = self._softmax(*self._classes(h1)), self._softmax(*self._words(h1, cut))
        d1.reshape(-1)[each + cls] -= 1
        d2.reshape(-1)[each + word] -= 1
        gw1, gw2, dh = h1.T @ d1, np.zeros((CLASSES, HIDDEN + 1, CLASSES), np.float32), d1 @ np.ascontiguousarray(self.params[3].T)
        for c, (a, b) in enumerate(zip(cut, cut[1:])):
            if a < b:
                np.matmul(h1[a:b].T, d2[a:b], out=gw2[c])
                dh[a:b] += d2[a:b] @ self.params[5][c].T
        gw1, gw2 = gw1 / n, gw2 / n
        nodes = (np.zeros(0, np.int32), np.zeros(0, np.int64), [self.nodes[:0], self.bias[:0]])
        if self.tree.size:
            below, leaves = self.tree.below(ids)
            longest, start, sizes = self._levels(leaves)
            if sizes:
                below = below[longest][:sizes[0]]
                hb, total, at = h.take(below, axis=0), np.zeros((len(below), HIDDEN), np.float32), 0
                node, d3, pull = np.empty(sum(sizes), np.int32), np.empty(sum(sizes), np.float32), np.empty((sum(sizes), HIDDEN), np.float32)
                for k, m in enumerate(sizes):
                    some = slice(at, at + m)
                    node[some], right, z, at_node = self._level(hb[:m], start[:m] + k)
                    np.maximum(z, -30, out=z)
                    np.exp(np.negative(z, out=z), out=z)
                    z += 1
                    np.subtract(np.reciprocal(z, out=z), right, out=d3[some])
                    at_node *= d3[some, None]
                    total[:m] += at_node
                    d3[some] /= n
                    np.multiply(hb[:m], d3[some, None], out=pull[some])
                    at += m
                dh[below] = dh.take(below, axis=0) + total
                nodes = _rows_of(node, pull, d3)
        dh *= 1 - h * h
        dh /= n
        dz, ones = np.zeros_like(hidden), np.ones(len(targets), np.float32)
        dz.reshape(-1, HIDDEN)[real] = dh
        back, gs, m, part = np.zeros_like(rows), np.zeros_like(self.params[1]), dz.shape[1], np.empty((len(dz), dz.shape[1] * HIDDEN), np.float32)
        dz, rows, wide = dz.reshape(part.shape), rows.reshape(len(rows), -1), back.reshape(len(rows), -1)
        for k, o in enumerate(OFFSETS):
            some = slice((2 + o) * HIDDEN, (2 + o + m) * HIDDEN)
            wide[:, some] += np.multiply(dz, np.tile(self.params[1][k], m), out=part)
            gs[k] = ones @ np.multiply(dz, rows[:, some], out=part).reshape(-1, HIDDEN)
        emb = _rows_of(spans.reshape(-1), back.reshape(-1, HIDDEN))
        return [gs, ones[:len(dh)] @ dh, gw1[:HIDDEN], gw1[HIDDEN], gw2[:, :HIDDEN], gw2[:, HIDDEN]], emb, nodes

    def step(self, spans: np.ndarray, sums: list[np.ndarray], rate: float) -> None:
        """One adaptive gradient step; rows that it doesn't meet stay as they are."""
        dense, (met, _, (g,)), (node, _, (gn, gb)) = self.gradients(spans)
        _move_rows(self.params[0], sums[0], met, g, rate)
        for p, g, s in zip(self.params[1:], dense, sums[1:7]):
            s += g * g
            p -= rate * g / (np.sqrt(s) + np.float32(1e-6))
        _move_rows(self.nodes, sums[7], node, gn, rate)
        sums[8][node] = total = sums[8].take(node) + gb * gb
        self.bias[node] = self.bias.take(node) - rate * gb / (np.sqrt(total) + np.float32(1e-6))

    def sums(self) -> list[np.ndarray]:
        """Where the squared gradients of the steps start: a number a row of the
        words' tables, else one a weight."""
        start = [np.full_like(p, 1e-6) for p in self.params[1:]]
        return [np.full(len(self.params[0]), 1e-6, np.float32), *start, *(np.full(self.tree.size, 1e-6, np.float32) for _ in range(2))]

    def top(self) -> np.ndarray:
        """All that doesn't belong to a word of the trees."""
        return np.concatenate([p.reshape(-1) for p in (self.params[0][:VOCAB + 1], *self.params[1:])])


def _segments(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the segments that start at ``first``; rows of floats are added in
    pairs, as complex numbers, which takes half the time."""
    if rows.ndim == 1:
        return np.add.reduceat(rows, first)
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


def _with_ones(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Some rows and a column of ones, for sums and constants beside a product."""
    out = np.ones((len(at), HIDDEN + 1), np.float32)
    out[:, :HIDDEN] = rows.reshape(-1, HIDDEN).take(at, axis=0)
    return out


def _rows_of(ids: np.ndarray, *values: np.ndarray) -> tuple:
    """Distinct ids, how often each occurs, and sums of the values by id."""
    # sorting ids and places as one number is several times faster than argsort
    both = (ids.astype(np.int64) << 32) + np.arange(len(ids))
    both.sort()
    order, ids = both & 0xFFFFFFFF, (both >> 32).astype(np.int32)
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    times = np.diff(first, append=len(ids))
    # the frequent ids first: those with a second row, a third, .. are a slice
    rounds = np.minimum(times, ROUNDS + 1)
    by = np.argsort((-rounds).astype(np.int16), kind="stable")
    first, times = first[by], times[by]
    many, *sizes = (len(times) - np.cumsum(np.bincount(rounds, minlength=ROUNDS + 1)))[ROUNDS:0:-1].tolist()
    takes = [order[first[many:m] + k] for k, m in enumerate(sizes[::-1], 1) if m > many]
    start = np.cumsum(times[:many]) - times[:many]
    crowd = order[np.repeat(first[:many] - start, times[:many]) + np.arange(times[:many].sum())]
    sums = []
    for v in values:
        total = v.take(order[first], axis=0)
        if takes:
            # the first row comes last, as in a segment
            further = v.take(takes[0], axis=0)
            for some in takes[1:]:
                further[:len(some)] += v.take(some, axis=0)
            total[many:many + len(further)] += further
        if many:
            total[:many] = _segments(v.take(crowd, axis=0), start)
        sums.append(total)
    return ids.take(first).astype(np.int64), times, sums


def _move_rows(p: np.ndarray, s: np.ndarray, at: np.ndarray, g: np.ndarray, rate: float) -> None:
    total = s.take(at) + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
    s[at] = total
    p[at] = p.take(at, axis=0) - g * (rate / (np.sqrt(total) + np.float32(1e-6)))[:, None]


def padded_ids(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids with two padding words around each, and the places of the words."""
    pad = np.full(2, VOCAB, np.int32)
    parts, places, at = [], [], 0
    for d in docs:
        parts += [pad, d, pad]
        places.append(np.arange(at + 2, at + 2 + len(d)))
        at += len(d) + 4
    return (np.concatenate(parts), np.concatenate(places)) if docs else (pad, np.zeros(0, np.int64))


def _windows(ids: np.ndarray) -> np.ndarray:
    """Rows of SPAN places, each with the two ids before and behind; the first
    and the last two ids are only such neighbours."""
    wide = np.full(-(-(len(ids) - 4) // SPAN) * SPAN + 4, VOCAB, np.int32)
    wide[:len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(wide, SPAN + 4)[::SPAN]


def stretches(padded: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """All places in SPANS rows of SPAN a step, in shuffled order, each row with
    the two words before and behind."""
    pad = np.full(2, VOCAB, np.int32)
    rows = _windows(np.concatenate([pad, padded, pad]))
    order = rng.permutation(len(rows))
    for a in range(0, len(rows), SPANS):
        yield rows[order[a:a + SPANS]]


def _groups(texts, limit: int = GROUP_BYTES) -> Iterator[list]:
    """Neighbouring texts, cut when ``limit`` bytes are reached."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def _blocks(batch: pa.RecordBatch) -> Iterator[list[list]]:
    """Groups of a batch's texts, GROUPS at a time."""
    groups = _groups(t.as_py() for t in batch.column(1))
    while some := list(islice(groups, GROUPS)):
        yield some


_NETS = "k long, block int, ids binary, times binary, w binary"


def _net_row(k: int, block: int, ids: np.ndarray, times: np.ndarray, w: np.ndarray) -> dict:
    return {"k": k, "block": block, "ids": ids.astype(np.int32).tobytes(), "times": times.astype(np.float64 if block < 0 else np.float32).tobytes(),
            "w": w.astype(np.float32 if block < 0 else np.float16).tobytes()}


def _train(words: list[bytes], tree: Tree):
    """Per task: the network's top (block -1, times: tokens), and the rows of the
    words that it met in half precision, with how often they and their nodes were met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        vocab, net, rng, n = Vocabulary(words), Network(tree=tree), np.random.default_rng([SEED, task]), 0
        sums, met = net.sums(), np.zeros(tree.size + HASHED)
        for b in batches:
            for ids, _, _ in chain.from_iterable(map(vocab.coded, _blocks(b))):
                padded, places = padded_ids(ids)
                if not len(places):
                    continue
                n += len(places)
                leaves = tree.leaves(padded[places])
                met += np.bincount(leaves[leaves >= 0], minlength=len(met))
                for spans in stretches(padded, rng):
                    if (spans[:, 2:-2] != VOCAB).any():
                        net.step(spans, sums, RATE)
        if n:
            schema = pa.schema([("k", pa.int64()), ("block", pa.int32()), ("ids", pa.binary()), ("times", pa.binary()), ("w", pa.binary())])
            yield pa.RecordBatch.from_pylist([_net_row(task, -1, np.zeros(0), np.array([n]), net.top())], schema)
            # every place was a target once, and met the nodes of its leaf's path
            visits = np.bincount(tree.node, weights=np.repeat(met, np.diff(tree.start)), minlength=tree.size)
            for block in range(-(-tree.size // BLOCK)):
                a, b = block * BLOCK, min((block + 1) * BLOCK, tree.size)
                times = np.stack([met[a:b], visits[a:b]])
                ids = np.flatnonzero(times.any(axis=0))
                if len(ids):
                    rows = np.concatenate([net.params[0][VOCAB + 1 + a + ids], net.nodes[a + ids], net.bias[a + ids, None]], axis=1)
                    yield pa.RecordBatch.from_pylist([_net_row(task, block, ids, times[:, ids], rows)], schema)
    return run


def _average(table: pa.Table) -> pa.Table:
    """Of one block: each row by how often its word and its node were met."""
    block, emb = table["block"][0].as_py(), HIDDEN
    if block < 0:
        times = np.array([np.frombuffer(t.as_py())[0] for t in table["times"]])
        w = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) * m for x, m in zip(table["w"], times)) / times.sum()
        row = _net_row(table["k"][0].as_py(), block, np.zeros(0), np.array([times.sum()]), w)
    else:
        total, times = np.zeros((BLOCK, emb + HIDDEN + 1)), np.zeros((2, BLOCK))
        for i, t, w in zip(table["ids"], table["times"], table["w"]):
            i = np.frombuffer(i.as_py(), np.int32)
            t, w = np.frombuffer(t.as_py(), np.float32).reshape(2, -1), np.frombuffer(w.as_py(), np.float16).reshape(len(i), -1)
            total[i, :emb] += w[:, :emb] * t[0][:, None]
            total[i, emb:] += w[:, emb:] * t[1][:, None]
            times[:, i] += t
        total[:, :emb] /= np.maximum(times[0], 1)[:, None]
        total[:, emb:] /= np.maximum(times[1], 1)[:, None]
        ids = np.flatnonzero(times.any(axis=0))
        row = _net_row(table["k"][0].as_py(), block, ids, times[:, ids], total[ids])
    return pa.Table.from_pylist([row], table.schema)


def input_splits(rows: DataFrame) -> int:
    return rows.rdd.getNumPartitions()


def train(rows: DataFrame, words: list[bytes]) -> Network:
    """Networks of the trainers, averaged in a tree. A trainer reads the splits of
    at least as many bytes of words as its network takes, but no core is left idle."""
    tree = Tree(words if isinstance(words, Words) else Words(words))
    size = float(np.dot(words.counts, [len(w) + 1 for w in words])) if isinstance(words, Words) else 0.0
    trainers = max(rows.sparkSession.sparkContext.defaultParallelism, int(size / (tree.size * ROW_BYTES + 1)))
    if trainers < input_splits(rows):
        rows = rows.coalesce(trainers)
    nets = written(rows.mapInArrow(_train(words, tree), _NETS), "networks")
    count = nets.filter("block < 0").count()
    while count > 1:
        count = -(-count // FAN)
        nets = written(nets.groupBy(F.pmod(F.col("k"), F.lit(count)).alias("g"), "block").applyInArrow(
            lambda t: _average(t.select(["k", "block", "ids", "times", "w"])), _NETS), "networks")
        count = nets.filter("block < 0").count()
    net = Network(tree=tree)
    for r in nets.toLocalIterator():
        ids = np.frombuffer(r.ids, np.int32) + max(r.block, 0) * BLOCK
        if r.block < 0:
            top = Network(np.frombuffer(r.w, np.float32))
            net.params[0][:VOCAB + 1] = top.params[0]
            net.params[1:] = top.params[1:]
        else:
            w, (met, visits) = np.frombuffer(r.w, np.float16).reshape(len(ids), -1), np.frombuffer(r.times, np.float32).reshape(2, -1) > 0
            net.params[0][VOCAB + 1 + ids[met]] = w[met, :HIDDEN]
            net.nodes[ids[visits]], net.bias[ids[visits]] = w[visits, HIDDEN:-1], w[visits, -1]
    return net


def score(docs: DataFrame, words: list[bytes], net: Network, id_col: str = "doc_id", text_col: str = "text",
          counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_prob (sum over the words), mean_log_prob. With
    ``counts`` (word, n) the words without a leaf of their own have their share
    of it, else they count as one word."""
    rest = np.log(np.maximum(words.rest, 1)) if counts is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(words)
        for b in batches:
            sums, lens, rare, cuts = [np.zeros(0)], [np.zeros(0, np.int64)], [pa.array([], pa.binary())], [np.zeros(1, np.int64)]
            for ids, codes, found in chain.from_iterable(map(vocab.coded, _blocks(b))):
                padded, places = padded_ids(ids)
                each = np.concatenate([net.log_probs(padded, places[a:a + PIECE]) for a in range(0, len(places), PIECE)] or [np.zeros(0)])
                n = np.array([len(d) for d in ids], np.int64)
                ends = np.cumsum(n)
                if rest is not None:
                    targets = padded[places]
                    some = np.flatnonzero((targets >= VOCAB - HASHED) & (targets < VOCAB))
                    each[some] -= rest[targets[some] - (VOCAB - HASHED)]
                    rare.append(found.take(pa.array(codes[some])).cast(pa.binary()))
                    cuts.append(cuts[-1][-1] + np.searchsorted(some, ends))
                else:
                    cuts.append(np.zeros_like(n))
                total = np.concatenate([[0.0], np.cumsum(each)])
                sums.append(total[ends] - total[ends - n])
                lens.append(n)
            shared = pa.ListArray.from_arrays(pa.array(np.concatenate(cuts), pa.int32()), pa.concat_arrays(rare))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(lens)), pa.array(np.concatenate(sums)), shared],
                                             names=["doc_id", "n_words", "log_prob", "rare"])

    got = _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, log_prob double, rare array<binary>")
    mean = (F.col("log_prob") / F.greatest("n_words", F.lit(1))).alias("mean_log_prob")
    if counts is None:
        return got.select("doc_id", "n_words", "log_prob", mean)
    got = written(got.withColumn("row", F.monotonically_increasing_id()), "scores")
    # a word of the join occurs less than MIN_COUNT times in the corpus
    shares = (got.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row")
              .agg(F.sum(F.log(F.coalesce("n", F.lit(1)))).alias("share")))
    return (got.join(shares, "row", "left").select("doc_id", "n_words", (F.col("log_prob") + F.coalesce("share", F.lit(0.0))).alias("log_prob"))
            .select("doc_id", "n_words", "log_prob", mean))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Gather, train and score: every document by a network trained on all."""
    rows = _rows(docs, id_col, text_col)
    counts = count_words(rows)
    words = vocabulary(rows, counts)
    return score(docs, words, train(rows, words), id_col, text_col, counts)
