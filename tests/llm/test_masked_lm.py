"""Network, scores and training."""

import math
import random

import numpy as np
import pytest

from tessera.llm import masked_lm as lm


def naive(net, vocab, text):
    ids = vocab.ids((text or "").encode()).tolist()
    padded = [lm.VOCAB] * 2 + ids + [lm.VOCAB] * 2
    emb, scale, b0, w1, b1, w2, b2 = [p.astype(float) for p in net.params]
    total = 0.0
    for i, word in enumerate(ids):
        h = np.tanh(sum(emb[padded[i + 2 + o]] * scale[k] for k, o in enumerate(lm.OFFSETS)) + b0)
        c, w = divmod(word, lm.CLASSES)
        z1, z2 = h @ w1 + b1, h @ w2[c] + b2[c]
        total += z1[c] - math.log(np.exp(z1).sum()) + z2[w] - math.log(np.exp(z2).sum())
    return len(ids), total


def test_scores_equal_plain_loops_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    net = lm.Network(lm.Network().flat() + rng.standard_normal(lm.Network().flat().shape).astype(np.float32) * 0.3)
    words = [f"w{i}".encode() for i in range(400)]
    long = " ".join(f"w{i % 391}" for i in range(40_000))
    rows = [(1, "W1 w2, w3 unknown Ünï w5", "x"), (2, None, "x"), (3, "", "x"), (4, " .,- ", None), (5, "w1", "x"), (5, "w1", "x"), (None, "w7 w8 w9", "x"), (6, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted(((str(r.doc_id), r.n_words, r.log_prob, r.mean_log_prob) for r in lm.score(df, words, net).collect()), key=lambda r: (r[0], r[1]))
    vocab = lm.Vocabulary(words)
    want = sorted(((str(d), *naive(net, vocab, t)) for d, t, _ in rows), key=lambda r: (r[0], r[1]))
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-4, abs=1e-4)
        assert g[3] == pytest.approx(w[2] / max(1, w[1]), rel=1e-4, abs=1e-4)
    assert lm.pseudo_likelihood(df.limit(0)).count() == 0
    assert lm.pseudo_likelihood(df).count() == len(rows)


def spans_of(padded):
    return np.concatenate(list(lm.stretches(padded, np.random.default_rng(0))))


def test_gradient():
    net, rng = lm.Network(), np.random.default_rng(2)
    padded, at = lm.padded_ids([rng.integers(0, lm.VOCAB, 40).astype(np.int32) for _ in range(3)])
    loss = lambda: -net.log_probs(padded, at).mean()
    dense, (met, times, (rows,)), _ = net.gradients(spans_of(padded))
    emb = np.zeros_like(net.params[0])
    emb[met] = rows
    for k, grad in enumerate([emb, *dense]):
        for i in {np.abs(grad).argmax(), grad.argmax(), grad.argmin()}:
            i = np.unravel_index(i, grad.shape)
            old, ends = net.params[k][i], []
            for move in (1e-2, -1e-2):
                net.params[k][i] = old + move
                ends.append(loss())
            net.params[k][i] = old
            assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(float(grad[i]), rel=0.05, abs=1e-5), k


def test_training_prefers_real_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    rows = lm._rows(docs, "doc_id", "text")
    words = lm.vocabulary(rows)
    net = lm.train(rows, words)
    rng = random.Random(3)
    texts = [r.text for r in docs.orderBy("doc_id").limit(150).collect()]
    vocab = lm.Vocabulary(words)
    mean = lambda ts: np.mean([net.log_probs(*lm.padded_ids([vocab.ids(t.encode())])).mean() for t in ts if len(t.split()) > 20])
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    assert mean(texts) > mean(mixed) + 0.01
    assert mean(texts) > -math.log(lm.VOCAB)


def test_tree_of_averages(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)
    docs = spark.createDataFrame([(i, f"some words number {i} here again") for i in range(60)], "doc_id long, text string").repartition(9)
    rows = lm._rows(docs, "doc_id", "text")
    net = lm.train(rows, lm.vocabulary(rows))
    assert np.isfinite(net.flat()).all() and not np.allclose(net.flat(), lm.Network().flat())


def test_probabilities_are_of_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "MIN_COUNT", 5)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.2, 300) % 5000) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lm._rows(docs, "doc_id", "text")
    counts = lm.count_words(rows)
    n = {bytes(r.word): r.n for r in counts.collect()}
    words = lm.vocabulary(rows, counts)
    assert set(words) >= {w for w in n if n[w] >= 5} and len(words) > lm.VOCAB - lm.HASHED
    net = lm.train(rows, words)
    vocab = lm.Vocabulary(words)
    assert len({vocab[w] for w in words}) == len(words) == vocab.own
    # in one context, the probabilities of all words of the corpus add up to those of buckets that have words
    rest = {}
    for w in n.keys() - set(words):
        rest[vocab[w]] = rest.get(vocab[w], 0) + n[w]
    assert all(words.rest[i - lm.VOCAB + lm.HASHED] == rest[i] for i in rest)
    ids = [*range(lm.VOCAB), *(vocab[w] for w in words[lm.VOCAB - lm.HASHED:])]
    padded, at = lm.padded_ids([np.array([vocab[b"w1"], vocab[b"w2"], i, vocab[b"w3"], vocab[b"w4"]], np.int32) for i in ids])
    assert np.exp(net.log_probs(padded, at[2::5])).sum() == pytest.approx(1, abs=1e-3)
    # a document's score is the sum over its words, each with its share
    got = {r.doc_id: r.log_prob for r in lm.score(docs, words, net, counts=counts).collect()}
    for d, t in list(enumerate(texts))[:10]:
        found = [w.encode() for w in t.split()]
        want = net.log_probs(*lm.padded_ids([vocab.ids(t.encode())])).sum()
        want += sum(math.log(n[w] / rest[vocab[w]]) for w in found if vocab[w] in rest)
        assert got[d] == pytest.approx(want, rel=1e-6)


def test_gradient_of_the_trees():
    words = lm.Words([f"w{i}".encode() for i in range(3000)], 1000.0 / np.arange(1, 3001), np.full(lm.HASHED, 0.3))
    net, rng = lm.Network(tree=lm.Tree(words)), np.random.default_rng(6)
    net.nodes += rng.standard_normal(net.nodes.shape).astype(np.float32) * 0.3
    padded, at = lm.padded_ids([rng.choice([*range(lm.VOCAB), *range(lm.VOCAB + 1, lm.VOCAB + 2400)], 60).astype(np.int32)])
    _, (met, _, (rows,)), (node, _, (gn, gb)) = net.gradients(spans_of(padded))
    for table, at_rows, grad in ((net.nodes, node, gn), (net.bias, node, gb), (net.params[0], met, rows)):
        i = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        cell = (at_rows[i[0]], *i[1:])
        old, ends = table[cell], []
        for move in (1e-2, -1e-2):
            table[cell] = old + move
            ends.append(-net.log_probs(padded, at).mean())
        table[cell] = old
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(float(grad[i]), rel=0.05)


def test_every_position_is_a_target_once(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(lm.Network, "step", lambda self, spans, sums, rate: steps.append(spans.copy()))
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    texts = [b"a b c d e f g " * 5000, b"", b"one two"]
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array([1, 2, 3]), lm.pa.array(texts)], names=["doc_id", "text"])
    list(lm._train([b"a"], lm.Tree([b"a"]))(iter([batch])))
    padded, places = lm.padded_ids([lm.Vocabulary([b"a"]).ids(t) for t in texts])
    contexts = lambda ids, at: sorted(zip(*(ids[at + o].tolist() for o in (-2, -1, 0, 1, 2))))
    seen = []
    for s in np.concatenate(steps):
        at = 2 + np.flatnonzero(s[2:-2] != lm.VOCAB)
        seen += contexts(s, at)
    assert len(steps) > 1 and sorted(seen) == contexts(padded, places)


def test_own_words_are_bounded(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{i}".encode(), int(3000 / (i + 1)) + 1) for i in range(2000)], "word binary, n long")
    n = sorted((r.n for r in counts.collect()), reverse=True)
    assert lm.own_count(counts, 10_000) == lm.MIN_COUNT
    for bound in (3, 20, 90, 150):
        least = lm.own_count(counts, bound)
        own = sum(x >= least for x in n)
        assert least >= lm.MIN_COUNT and own <= bound
        # a step of counts more would not fit
        assert sum(x >= max(lm.MIN_COUNT, least / 2 ** 0.125 - 1) for x in n) > bound or least == lm.MIN_COUNT
    monkeypatch.setattr(lm, "OWN", 1)
    rows = lm._rows(spark.createDataFrame([(1, " ".join(f"w{i % 700}" for i in range(30_000)))], "doc_id long, text string"), "doc_id", "text")
    # no fewer than the leaves of the two-step softmax
    assert len(lm.vocabulary(rows)) == lm.VOCAB - lm.HASHED


def test_trainers_follow_the_networks_size(spark, monkeypatch):
    monkeypatch.setattr(lm, "ROW_BYTES", 10_000_000)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 900}" for j in range(300))) for i in range(200)], "doc_id long, text string").repartition(40)
    rows = lm._rows(docs, "doc_id", "text")
    seen, real = [], lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: seen.append((name, out := real(df, name))) or out)
    net = lm.train(rows, lm.vocabulary(rows))
    first = next(df for name, df in seen if name == "networks")
    assert first.filter("block < 0").count() <= spark.sparkContext.defaultParallelism < 40
    assert np.isfinite(net.flat()).all()


def test_a_step_takes_classes_and_paths_together(monkeypatch):
    """A softmax for all classes of a step, not one a class, and paths level by level: the same numbers as word by word."""
    words = lm.Words([f"w{i}".encode() for i in range(3000)], 1000.0 / np.arange(1, 3001), np.full(lm.HASHED, 0.3))
    net, rng, calls = lm.Network(tree=lm.Tree(words)), np.random.default_rng(7), []
    net.nodes += rng.standard_normal(net.nodes.shape).astype(np.float32) * 0.3
    net.params[5] += rng.standard_normal(net.params[5].shape).astype(np.float32)
    padded, at = lm.padded_ids([rng.choice([*range(lm.VOCAB), *range(lm.VOCAB + 1, lm.VOCAB + 2400)], 300).astype(np.int32)])
    plain = lm.Network._softmax
    monkeypatch.setattr(lm.Network, "_softmax", staticmethod(lambda z, small: calls.append(len(z)) or plain(z, small)))
    net.gradients(spans_of(padded))
    assert calls == [len(at), len(at)]
    tree, (w1, b1, w2, b2) = net.tree, [p.astype(float) for p in net.params[3:]]
    got, hidden = net.log_probs(padded, at), net._hidden(padded[at.min() - 2:at.max() + 3])[1]
    for i, h, p in zip(padded[at].tolist(), hidden.astype(float), got):
        c, w = divmod(int(tree.tops(np.array([i]))[0]), lm.CLASSES)
        z1, z2, leaf = h @ w1 + b1, h @ w2[c] + b2[c], int(tree.leaves(np.array([i]))[0])
        want = z1[c] - math.log(np.exp(z1).sum()) + z2[w] - math.log(np.exp(z2).sum())
        for j in range(tree.start[leaf], tree.start[leaf + 1]) if leaf >= 0 else ():
            z = float(net.nodes[tree.node[j]] @ h + net.bias[tree.node[j]])
            want -= math.log1p(math.exp(-z if tree.right[j] else z))
        assert p == pytest.approx(want, abs=1e-4)


def test_rows_are_added_up_by_id():
    rng = np.random.default_rng(9)
    for ids in (np.array([5], np.int32), np.array([3, 3, 3], np.int32), rng.integers(0, 40, 60).astype(np.int32), np.arange(9, dtype=np.int32)[::-1]):
        wide, single = rng.standard_normal((len(ids), lm.HIDDEN)).astype(np.float32), rng.standard_normal(len(ids)).astype(np.float32)
        met, times, (a, b) = lm._rows_of(ids, wide, single)
        assert sorted(met.tolist()) == sorted(set(ids.tolist()))
        for i, n, x, y in zip(met, times, a, b):
            assert n == (ids == i).sum() and y == pytest.approx(single[ids == i].sum(), abs=1e-5)
            np.testing.assert_allclose(x, wide[ids == i].sum(axis=0), atol=1e-5)


def test_words_are_looked_up_once_a_block(monkeypatch):
    """Ids and counts come from the distinct words of some groups of texts, not from one lookup a word."""
    rng, own = np.random.default_rng(11), [f"w{i}".encode() for i in range(600)]
    some = lambda n: b" ".join(b"W%d," % i for i in rng.zipf(1.3, n) % 3000)
    texts = [b"", b" .,- ", *(some(200) for _ in range(9)), b"", "Ünï -w1-W1\x00w2".encode(), some(700), b"", b"w5", b" ., " * 200]
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array(range(len(texts))), lm.pa.array(texts, lm.pa.binary())], names=["doc_id", "text"])
    vocab, looked = lm.Vocabulary(lm.Words(own)), []
    monkeypatch.setattr(lm, "_groups", lambda texts, real=lm._groups: real(texts, 400))
    monkeypatch.setattr(lm.Vocabulary, "get", lambda self, w, other: looked.append(w) or (self[w] if w in self else other))
    blocks = list(lm._blocks(batch))
    assert len(blocks) > 2 and [t for b in blocks for g in b for t in g] == texts
    got, words = [], []
    for block in blocks:
        looked.clear()
        for ids, codes, found in vocab.coded(block):
            got += [i.tolist() for i in ids]
            words += found.take(lm.pa.array(codes)).to_pylist()
        assert len(looked) == len(set(looked)) == len({w for g in block for t in g for w in lm.words_of(t)})
    assert got == [vocab.ids(t).tolist() for t in texts]
    assert words == [w for t in texts for w in lm.words_of(t)]
    for least in (lm.COUNTED, 100):
        monkeypatch.setattr(lm, "COUNTED", least)
        n = {}
        for b in lm._word_counts(iter([batch, batch])):
            for w, k in zip(b["word"].to_pylist(), b["n"].to_pylist()):
                n[w] = n.get(w, 0) + k
        assert n == {w: 2 * words.count(w) for w in set(words)}
    assert not list(lm._word_counts(iter([])))


def test_rows_of_frequent_ids_are_added_in_rounds(monkeypatch):
    """Segments take only the rows of ids that have more than ROUNDS."""
    rng, seen, plain = np.random.default_rng(12), [], lm._segments
    monkeypatch.setattr(lm, "_segments", lambda rows, first: seen.append(len(rows)) or plain(rows, first))
    for many in (1, lm.ROUNDS - 1, lm.ROUNDS, lm.ROUNDS + 1, 5 * lm.ROUNDS):
        ids = rng.permutation(np.repeat(np.arange(7), [1, 1, 2, 3, many, 1, many])).astype(np.int32)
        rows = rng.standard_normal((len(ids), lm.HIDDEN)).astype(np.float32)
        seen.clear()
        met, times, (got,) = lm._rows_of(ids, rows)
        assert sum(seen) == (2 * many if many > lm.ROUNDS else 0)
        assert sorted(met.tolist()) == list(range(7))
        for i, n, x in zip(met, times, got):
            assert n == (ids == i).sum()
            np.testing.assert_allclose(x, rows[ids == i].sum(axis=0), atol=1e-5)


def test_visits_of_nodes_are_those_of_the_steps(monkeypatch):
    """How often a node was met follows from the words of the texts, without a number a node and step."""
    words = lm.Words([f"w{i}".encode() for i in range(900)], 1000.0 / np.arange(1, 901), np.full(lm.HASHED, 0.3))
    tree, rng, plain = lm.Tree(words), np.random.default_rng(13), lm.Network.gradients
    want = np.zeros(tree.size)

    def counted(self, spans):
        dense, emb, (node, times, grads) = plain(self, spans)
        want[node] += times
        return dense, emb, (node, times, grads)

    monkeypatch.setattr(lm.Network, "gradients", counted)
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    texts = [b"", *(b" ".join(b"w%d" % i for i in rng.integers(0, 1200, 3000)) for _ in range(5)), b" , "]
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array(range(7)), lm.pa.array(texts)], names=["doc_id", "text"])
    top, *rows = [r for b in lm._train(words, tree)(iter([batch])) for r in b.to_pylist()]
    assert np.frombuffer(top["times"])[0] == 15_000 and not hasattr(lm.Network(tree=tree), "visits")
    got, met, n = np.zeros(tree.size), np.zeros(tree.size), lm.Vocabulary(words)
    for r in rows:
        ids = np.frombuffer(r["ids"], np.int32) + r["block"] * lm.BLOCK
        met[ids], got[ids] = np.frombuffer(r["times"], np.float32).reshape(2, -1)
    assert want.any() and (got == want).all()
    all_ids = np.concatenate([n.ids(t) for t in texts])
    assert (met == np.bincount(all_ids[all_ids > lm.VOCAB] - (lm.VOCAB + 1), minlength=tree.size)).all()
