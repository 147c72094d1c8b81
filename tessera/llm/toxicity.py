"""Toxicity scores by weak supervision.

Many voters look at a text: words and word beginnings mined from labelled rows
(one voter each), a general lexicon, and patterns. A generative label model
holds, for each voter, how often it fires on toxic and on clean texts, and the
voters' correlations within the classes; it is fitted by EM over the votes on
the whole training part of the corpus, with the labelled rows as anchors. A
voter's weight in the posterior is divided by the number of voters it is
correlated with, so that nested beginnings of one word don't count repeatedly.
A linear classifier is then trained on the posterior labels of a bounded sample
of labelled rows (``fit_rows``), over the mined features, and scores all texts.

Rows whose crc32 of the id is 2 modulo 4 are held out: neither their labels nor
their votes are used. Labels, ids and other columns never enter a score.

Defined cases: null and empty texts get the score of a text without any
feature; rows without an id count as not held out and have no label; labels
that are null are ignored, of differing labels for one id the toxic one counts;
without labels the general lexicon and the patterns alone make the score; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, scratch_path, written

#: Labelled rows that features are mined from and the classifier is fitted on.
FIT_ROWS = 20_000
#: Mined features of the classifier; the first of them are also voters.
FEATURES = 2000
MINED_VOTERS = 120
#: Toxic rows that must have a feature for it to be mined.
MIN_TOXIC = 3
#: Features counted in a task before they are given out.
HELD_FEATURES = 400_000
PREFIXES = range(3, 11)
EM_ROUNDS = 6
THRESHOLD = 0.3
#: Odds that a given label is right, as a voter in a labelled row's posterior.
LABEL_ODDS = 5000.0

# A general lexicon of insults (whole words).
LEXICON = ["asshole", "bastard", "clown", "cretin", "disgusting", "dumb", "filthy", "fool", "idiot", "imbecile",
           "jerk", "kill", "loser", "moron", "pathetic", "pig", "scum", "shut", "stupid", "trash", "ugly", "vermin",
           "worthless"]

_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_YOU = re.compile(r"\b(?:you|your|du|tu|vous|usted)\b[^.!?]{0,40}\b(?:" + "|".join(LEXICON) + r")\b", re.I)
_SHOUT = re.compile(r"!{2,}|\?!|!\?")


def words_of(text: str) -> set[bytes]:
    """Distinct lower-cased runs of letters."""
    return set(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def features_of(word: bytes) -> Iterator[bytes]:
    """The word, its beginnings (``*``) and its proper beginnings (``+``)."""
    yield word + b"="
    for k in PREFIXES:
        if len(word) >= k:
            yield word[:k] + b"*"
            if len(word) > k:
                yield word[:k] + b"+"


class Matches:
    """Word -> which of some features it has. Most words are settled by their
    first three bytes, the rest are looked up once."""

    def __init__(self, features):
        self.features = frozenset(features)
        self.firsts = frozenset(f[:min(3, len(f) - 1)] for f in self.features)
        self.known: dict[bytes, tuple] = {}

    def of(self, word: bytes) -> tuple:
        if word[:3] not in self.firsts:
            return ()
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[word] = tuple(f for f in features_of(word) if f in self.features)
        return got

    def all(self, words: set[bytes]) -> set[bytes]:
        on: set[bytes] = set()
        for w in words:
            if w[:3] in self.firsts:
                on.update(self.of(w))
        return on


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: feature -> toxic rows, clean rows; given out whenever many are held."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> Iterator[pa.RecordBatch]:
        names = list(seen[0] | seen[1])
        for a in range(0, len(names), 100_000):
            some = names[a:a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.binary()), *(pa.array([seen[t][f] for f in some], pa.int64()) for t in (1, 0))],
                names=["f", "toxic", "clean"])
        for s in seen:
            s.clear()

    for b in batches:
        for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
            seen[toxic].update({f for w in words_of(text.as_py()) for f in features_of(w)})
            if len(seen[0]) + len(seen[1]) > HELD_FEATURES:
                yield from out()
    yield from out()


def _gain(a: float, b: float, n1: int, n0: int) -> float:
    """Likelihood ratio of a feature in a of n1 toxic and b of n0 clean rows."""
    share = (a + b) / (n1 + n0)
    if a <= share * n1:
        return 0.0

    def part(k: float, n: float) -> float:
        p = k / n if n else 0
        return sum(x * math.log(y / z) for x, y, z in ((k, p, share), (n - k, 1 - p, 1 - share)) if x > 0 and y > 0 and z > 0)
    return part(a, n1) + part(b, n0)


def mine(sample: DataFrame, features: int = FEATURES) -> list[bytes]:
    """The features that tell toxic from clean rows of ``sample`` (text, toxic), best first."""
    n1, n0 = (sample.filter("toxic").count(), sample.filter("NOT toxic").count())
    if not n1 or not n0:
        return []

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_gain(x, y, n1, n0) for x, y in rows], pa.float64())],
                                             names=["f", "gain"])

    counts = (sample.mapInArrow(_counts, "f binary, toxic long, clean long").groupBy("f")
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= MIN_TOXIC))
    best = counts.mapInArrow(gains, "f binary, gain double").filter("gain > 6").orderBy(F.desc("gain"), "f").limit(features)
    return [bytes(r.f) for r in best.collect()]


class Voters:
    """Which voters fire on a text: mined features first, then general ones."""

    def __init__(self, mined: list[bytes]):
        self.number = {f: i for i, f in enumerate(mined[:MINED_VOTERS])}
        self.lexicon = {w.encode(): len(self.number) + i for i, w in enumerate(LEXICON)}
        self.size = len(self.number) + len(LEXICON) + 3
        self.matches = Matches(self.number)

    def fires(self, text: str, words: set[bytes]) -> bytes:
        on = {self.number[f] for f in self.matches.all(words)} | {self.lexicon[w] for w in words & self.lexicon.keys()}
        own = self.size - 3
        if on and any(i >= len(self.number) for i in on) and _YOU.search(text):
            on.add(own)
        if _SHOUT.search(text):
            on.add(own + 1)
        if not on:
            on.add(own + 2)  # nothing speaks against the text
        row = np.zeros(self.size, np.uint8)
        row[list(on)] = 1
        return np.packbits(row).tobytes()


def _votes(mined: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(mined)
        for b in batches:
            seen: Counter = Counter()
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                t = text.as_py()
                seen[(voters.fires(t, words_of(t)), toxic)] += 1
            rows = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.bool_()),
                 pa.array([seen[r] for r in rows], pa.int64())], names=["votes", "toxic", "n"])
    return run


class LabelModel:
    """Firing rates by class, class share, and weights from the correlations."""

    def __init__(self, size: int, general_from: int):
        self.prior = 0.1
        self.on = np.full((2, size), 0.01)
        self.on[1, :] = 0.2
        self.on[:, -2] = 0.1
        self.on[0, -1], self.on[1, -1] = 0.9, 0.2
        self.weight = np.ones(size)
        self.weight[:] = 1 / 2

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic for rows of 0/1 votes."""
        fire = np.log(self.on[1] / self.on[0])
        rest = np.log((1 - self.on[1]) / (1 - self.on[0]))
        return votes @ (self.weight * (fire - rest)) + float(self.weight @ rest) + math.log(self.prior / (1 - self.prior))

    def posterior(self, votes: np.ndarray, toxic: list | None = None) -> np.ndarray:
        odds = self.odds(votes)
        if toxic is not None:
            odds = odds + np.array([0.0 if t is None else math.log(LABEL_ODDS) * (1 if t else -1) for t in toxic])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def update(self, n: np.ndarray, both: np.ndarray) -> None:
        """From class sizes n[c] and co-firing counts both[c] (voters x voters)."""
        self.prior = float(np.clip((n[1] + 1) / (n.sum() + 10), 1e-4, 0.5))
        rates = np.stack([(np.diag(both[c]) + s) / (n[c] + 1) for c, s in ((0, 0.02), (1, 0.05))])
        self.on = np.clip(rates, 1e-5, 1 - 1e-5)
        total = np.zeros_like(both[0])
        for c in (0, 1):
            if n[c] > 1:
                mean = np.diag(both[c]) / n[c]
                cov = both[c] / n[c] - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                total += np.clip(cov / np.outer(sd, sd), 0, 1) * n[c] / n.sum()
        np.fill_diagonal(total, 1)
        self.weight = 1 / total.sum(axis=1)


def _moments(model: LabelModel, size: int):
    """Per task: expected class sizes and co-firing counts, as (cell, clean, toxic)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both, some = np.zeros(2), np.zeros((2, size, size)), False
        for b in batches:
            if not b.num_rows:
                continue
            some = True
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            votes = np.unpackbits(raw, axis=1)[:, :size].astype(float)
            times = np.array(b.column(2).to_pylist(), float)
            p = model.posterior(votes, b.column(1).to_pylist())
            for c, w in ((0, times * (1 - p)), (1, times * p)):
                n[c] += w.sum()
                both[c] += votes.T @ (votes * w[:, None])
        if some:
            up = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([[-1], up[0] * size + up[1]]).astype(np.int32)),
                 pa.array(np.concatenate([[n[0]], both[0][up]])), pa.array(np.concatenate([[n[1]], both[1][up]]))],
                names=["cell", "clean", "toxic"])
    return run


def fit_label_model(votes: DataFrame, voters: Voters, rounds: int = EM_ROUNDS) -> LabelModel:
    """EM over vote patterns (votes, toxic or null, n): every round is one pass
    whose sums have a fixed size."""
    model = LabelModel(voters.size, len(voters.number))
    for _ in range(rounds):
        rows = (votes.mapInArrow(_moments(model, voters.size), "cell int, clean double, toxic double")
                .groupBy("cell").agg(F.sum("clean"), F.sum("toxic")).collect())
        n, both = np.zeros(2), np.zeros((2, voters.size, voters.size))
        for cell, clean, toxic in rows:
            if cell < 0:
                n[:] = clean, toxic
            else:
                i, j = divmod(cell, voters.size)
                both[:, i, j] = both[:, j, i] = clean, toxic
        if not n.sum():
            break
        model.update(n, both)
    return model


class Classifier:
    """Linear in the features' presence: a word's weight is the sum of its features'."""

    def __init__(self, features: list[bytes], weights: np.ndarray, bias: float):
        self.weights = {f: float(w) for f, w in zip(features, weights) if w}
        self.bias = bias
        self.matches = Matches(self.weights)

    def score(self, text: str) -> float:
        """Each feature counts once a text."""
        on = self.matches.all(words_of(text))
        odds = self.bias + math.fsum(self.weights[f] for f in on)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def fit_classifier(rows: list[list[int]], target: np.ndarray, features: list[bytes], l2: float = 0.1,
                   steps: int = 400) -> Classifier:
    """Logistic regression on posterior labels; rows hold the features' numbers."""
    m = len(features)
    cols = np.array([c for r in rows for c in r], np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, bias, n = np.zeros(m), -2.0, max(1, len(rows))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, w[cols], minlength=len(rows)) + bias if len(cols) else np.full(len(rows), bias)
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.append(np.bincount(cols, d[at], minlength=m) + l2 * w if len(cols) else l2 * w, d.sum()) / n
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        move = 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9) * (1 - step / (steps + 1))
        w, bias = w - move[:-1], bias - move[-1]
    return Classifier(features, w, bias)


def _sample_features(features: list[bytes], mined: list[bytes], size: int, model: LabelModel):
    """(posterior, feature numbers) of sample rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, voters, matches = {f: i for i, f in enumerate(features)}, Voters(mined), Matches(features)
        for b in batches:
            on, votes = [], []
            for text in b.column(0):
                t = text.as_py()
                words = words_of(t)
                on.append(sorted(number[f] for f in matches.all(words)))
                votes.append(np.unpackbits(np.frombuffer(voters.fires(t, words), np.uint8))[:size])
            p = model.posterior(np.array(votes, float).reshape(-1, size), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(on, pa.list_(pa.int32()))], names=["p", "on"])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", label_id: str = "doc_id", fit_rows: int = FIT_ROWS) -> Classifier:
    """Mine voters, fit the label model on all training rows, train the classifier."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    known = (labels.select(labels[label_id].cast("long").alias("k"), labels[label_col].alias("t"))
             .filter(F.col("k").isNotNull() & F.col("t").isNotNull()).filter(~held_out("k"))
             .groupBy("k").agg((F.max(F.col("t").cast("int")) > 0).alias("toxic")))
    # a hash decides which of more labelled rows are used; 5% are left as room for chance
    share = min(1.0, 0.95 * fit_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(fit_rows)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text)
    path = scratch_path(docs.sparkSession, "toxic-sample")
    rows.join(F.broadcast(chosen), rows["id"] == chosen["k"]).select("text", "toxic").write.parquet(path)
    sample = docs.sparkSession.read.parquet(path)
    features = mine(sample)
    voters = Voters(features)
    train_rows = rows.filter(~held_out("id")).join(F.broadcast(chosen), rows["id"] == chosen["k"], "left").select("text", "toxic")
    votes = written(train_rows.mapInArrow(_votes(features[:MINED_VOTERS]), "votes binary, toxic boolean, n long")
                    .groupBy("votes", "toxic").agg(F.sum("n").alias("n")), "votes")
    model = fit_label_model(votes, voters)
    everything = features + [w.encode() + b"=" for w in LEXICON if w.encode() + b"=" not in set(features)]
    got = sample.mapInArrow(_sample_features(everything, features[:MINED_VOTERS], voters.size, model),
                            "p double, on array<int>").toArrow()
    drop_path(docs.sparkSession, path)
    if not got.num_rows:
        fire = [model.odds(np.eye(voters.size)[i][None])[0] for i in voters.lexicon.values()]
        base = model.odds(np.eye(voters.size)[-1][None])[0]
        return Classifier([w.encode() + b"=" for w in LEXICON], np.array(fire) - base, float(base))
    return fit_classifier(got["on"].to_pylist(), np.array(got["p"].to_pylist()), everything)


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([classifier.score(t.as_py()) for t in b.column(2)], pa.float64())],
                names=["doc_id", "held_out", "score"])
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return (rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def drop_toxic(docs: DataFrame, classifier: Classifier, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows below the threshold, with all columns; judged where they are read."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([classifier.score(t.as_py() or "") < threshold for t in b.column(place)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
