import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import brown


def HELD():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def likelihood(pairs, of, k):
    m = np.eye(k)[of]
    n = m.T @ pairs @ m
    return brown._xlogx(n).sum() - brown._xlogx(n.sum(1)).sum() - brown._xlogx(n.sum(0)).sum()


def test_exchange_raises_likelihood_and_finds_planted_classes():
    rng = np.random.default_rng(15)
    true = rng.integers(0, 4, 40)
    pairs = rng.poisson(np.where((true[:, None] + 1) % 4 == true[None, :], 30, 0.5)).astype(float)
    of, between = brown.exchange(pairs, 4)
    m = np.eye(4)[of]
    assert np.allclose(between, m.T @ pairs @ m)
    assert likelihood(pairs, of, 4) > likelihood(pairs, np.arange(40) % 4, 4)
    assert len({(a, b) for a, b in zip(of, true)}) == 4


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(16)
    classes, words = 5, 60
    kind, n = rng.integers(0, classes, words), rng.integers(1, 30, words)
    n[:20] = 1
    size = np.bincount(kind, n, classes)
    singles = np.bincount(kind[n == 1], minlength=classes)
    model = brown.Model(rng.poisson(3, (classes, classes)).astype(float), size, singles, int(n.sum()), words, 0.9)
    for before in range(classes + 1):
        known = 10 ** model.log10(kind, n, np.full(words, before))
        unknown = 10 ** model.log10(np.array([classes]), np.array([0]), np.array([before]))
        assert math.isclose(known.sum() + unknown[0], 1, rel_tol=1e-9)


@pytest.mark.parametrize("block", [800_000, 300])
def test_scores_of_a_corpus(spark, monkeypatch, block):
    monkeypatch.setattr(brown, "BLOCK_TOKENS", block)
    rng = random.Random(17)
    lexicon = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    texts = []
    for i in range(120):
        c = rng.randrange(3)
        texts.append(" ".join(lexicon[c][min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randrange(1, 90))) + (f" Rare{i}" if i % 3 else ""))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, id string, block int").repartition(3)
    rows = brown.score(docs, HELD(), classes=6, core_words=20).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: t.encode().lower().split() + [b""]
    count = Counter(w for i, t in enumerate(texts) if not held(i) for w in tokens(t))
    total = sum(count.values())
    assert len(rows) == 120
    for r in rows:
        w = tokens(texts[r.id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.id), len(w), sum(count[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (total + len(count) + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def plain_scores(texts, held, classes, core_words, rounds, share=0.9):
    """The score of each text by dictionaries; only the sequential start uses the operator's own exchange."""
    tokens = [t.encode().lower().split() + [b""] for t in texts]
    line = [b""] + [w for i, ws in enumerate(tokens) if not held(i) for w in ws]
    count, bigram = Counter(line[1:]), Counter(zip(line, line[1:]))
    top = sorted(count, key=lambda w: (-count[w], w))[:core_words]
    matrix = np.array([[bigram[a, b] for b in top] for a in top], float)
    of, between = brown.exchange(matrix, classes)
    kind = dict(zip(top, map(int, of)))
    for turn in range(rounds):
        if turn:
            between = np.zeros((classes, classes))
            for (a, b), n in bigram.items():
                between[kind[a], kind[b]] += n
        smooth, new = between + 0.5, {}
        for w in count:
            left, right = np.zeros(classes), np.zeros(classes)
            for (a, b), n in bigram.items():
                if b == w and a in kind:
                    left[kind[a]] += n
                if a == w and b in kind:
                    right[kind[b]] += n
            gain = np.zeros(classes)
            for k in range(classes):
                ins, outs = smooth[:, k].copy(), smooth[k].copy()
                total_in, total_out = ins.sum(), outs.sum()
                if kind.get(w) == k:
                    ins, outs = np.maximum(ins - left, 0.5), np.maximum(outs - right, 0.5)
                    total_in, total_out = max(total_in - left.sum(), 0.5), max(total_out - right.sum(), 0.5)
                gain[k] = sum(left[j] * math.log(ins[j] / total_in) + right[j] * math.log(outs[j] / total_out) for j in range(classes))
            best = int(gain.argmax())
            new[w] = kind[w] if w in kind and (not turn or gain[kind[w]] >= gain[best] - 1e-9) else best
        kind = new
    pairs, size, singles = np.zeros((classes, classes)), np.zeros(classes), np.zeros(classes)
    for (a, b), n in bigram.items():
        pairs[kind[a], kind[b]] += n
    for w, n in count.items():
        size[kind[w]] += n
        singles[kind[w]] += n == 1
    total, types = sum(count.values()), len(count)
    even = size / total

    def chance(before, w):
        row = pairs[kind[before]] if before in kind else None
        seen = 0 if row is None else (row > 0).sum()
        follow = even if row is None or not row.sum() else (row + seen * even) / (row.sum() + seen)
        fresh = np.minimum(0.5, singles / np.maximum(1, size))
        by_class = follow[kind[w]] * (1 - fresh[kind[w]]) * count[w] / size[kind[w]] if w in kind else follow @ fresh
        return share * by_class + (1 - share) * (count[w] + 1) / (total + types + 1)

    return [sum(math.log10(chance(a, w)) for a, w in zip([b""] + ws, ws)) for ws in tokens]


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_scores_equal_a_plain_computation(spark, monkeypatch, rounds):
    monkeypatch.setattr(brown, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(brown, "HOME_WORDS", 40)
    rng = random.Random(23)
    words = [f"w{i}" for i in range(80)] + ["É", "漢"]
    texts = [" ".join(words[min(81, int(rng.expovariate(0.05)))] for _ in range(rng.randrange(0, 40))) + f" own{i % 7 * i}" for i in range(60)] + ["the " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    # the order of texts decides which words meet across texts: an end token stands between all of them, so it does not matter
    want = plain_scores(texts, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, 5, 12, rounds)
    got = {r.id: r.score for r in brown.score(docs, HELD(), classes=5, core_words=12, rounds=rounds).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(want):
        assert math.isclose(got[i], x, rel_tol=1e-6), (i, got[i], x)


def test_counts_over_a_byte_and_own_counts():
    between = np.array([[1.0, 900.0], [900.0, 1.0]])
    counts = np.zeros((4, 6))
    counts[0, 0] = counts[1, 3] = 5  # after, and before, words of class 0
    counts[2, 1] = counts[3, 1] = 300
    assert brown.best_classes(counts, between, np.array([2, 2, 2, 1])).tolist() == [1, 1, 0, 0]


def test_odd_documents(odd_docs, no_docs):
    rows = brown.score(odd_docs, HELD()).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.id in (3, 4, 5)} == {1}
    assert brown.score(no_docs, HELD()).count() == 0
    rows = brown.score(odd_docs, F.lit(True)).collect()  # nothing to learn from
    assert all(r.train_tokens == 0 and math.isclose(r.score, r.base_score, abs_tol=1e-9) for r in rows)


@pytest.mark.parametrize("classes", [1, 128, 300])
def test_classes_that_a_byte_cannot_hold(spark, no_docs, classes):
    with pytest.raises(ValueError):
        brown.score(no_docs, HELD(), classes=classes)
