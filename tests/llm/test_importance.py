import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import importance


def naive_grams(text, bits):
    """Counter of buckets, by its own walk through the text."""
    full = xxhash.xxh64_intdigest
    core = lambda w: full("".join(c for c in w if c.isalnum()) or w)
    h = lambda s: xxhash.xxh64_intdigest(s) >> (64 - bits)
    out, last, run = Counter(), None, 0
    for word in text.lower().split():
        run = run + 1 if word == last else 0
        before, last = last, word
        if not run and before is not None:
            mixed = ((core(before) * importance.PAIR_A + core(word)) * importance.PAIR_B) % (1 << 64)
            out[(1 << bits) + (mixed >> (64 - bits))] += 1
        if run:
            out[h(f"={min(run, 4)}")] += 1
            continue
        for t in importance._TOKEN.findall(word):
            out[h(t)] += 1
            for n in (5, 7):
                if t[0].isalpha() and len(t) > n:
                    out[h("^" + t[:n])] += 1
    return out


def test_grams_of_texts():
    rng = random.Random(11)
    grams = importance.NGrams(20)
    texts = ["", "A a a a a a b", "idiot### École, x_1 !!"] + [" ".join(rng.choice(["der", "Der", "longerword,", "x|y", "|", "fünfzehn"]) for _ in range(80)) for _ in range(20)]
    for text, (ids, repeats) in zip(texts, grams.texts(texts)):
        assert Counter(np.concatenate([grams.expand(ids), repeats, grams.pairs(ids)]).tolist()) == naive_grams(text, 20)


@pytest.mark.parametrize("bins", [4, 4096])
def test_kth_largest(spark, bins):
    rng = random.Random(12)
    values = [rng.choice([rng.gauss(0, 1), 0.5, -3.0, 1e6]) for _ in range(700)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 100, 350, 699):
        assert importance.kth_largest(keys, k, bins) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(keys, 700) is None and importance.kth_largest(keys.limit(0), 3) is None


def corpus(spark):
    rng = random.Random(13)
    good = lambda: " ".join(rng.choice(["the", "river", "stone", "under", "bridge", "quiet", "evening"]) for _ in range(40))
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = good() + (" you total moron " + good() if bad else "")
        rows.append((i, text, "s", 1.0))
        if i % 2 or i % 8 == 0:
            labels.append((i, not bad))
    return spark.createDataFrame(rows, "doc_id long, text string, good string, log_ratio double"), spark.createDataFrame(labels, "id long, good boolean")


def test_rejects_what_labels_reject(spark):
    docs, labels = corpus(spark)
    fit = importance.Resampler(docs, labels, carry=True)
    rows = fit.kept_documents().collect()
    kept = {r.doc_id for r in rows}
    assert {r.id for r in fit.kept().collect()} == kept
    assert not any(i % 4 == 0 for i in kept) and len(kept) >= 440
    assert fit.kept_documents().columns == docs.columns
    texts = {r.doc_id: tuple(r) for r in docs.collect()}
    assert all(tuple(r) == texts[r.doc_id] for r in rows)


@pytest.mark.parametrize("bits", [6, 14])
def test_ratios_keys_and_kept_rows_equal_brute_force(spark, bits):
    rng = random.Random(19)
    common, junk = ["the", "river,", "stone", "under", "bridge", "quiet", "evening", "Tuesday"], ["buy", "cheap", "clickhere", "!!!", "pills"]
    texts, good = [], {}
    for i in range(900):
        bad = rng.random() < 0.5
        own = junk if rng.random() < 0.9 and bad else ["lantern", "quay"]
        texts.append(" ".join(rng.choice(own if rng.random() < 0.3 else common) for _ in range(rng.randrange(0, 50))))
        if rng.random() < 0.6:
            good[i] = not bad
    texts[7] = None
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    fit = importance.Resampler(docs, spark.createDataFrame(list(good.items()), "id long, good boolean"), bits=bits)
    grams = [naive_grams(t or "", bits) for t in texts]
    raw, target = Counter(), Counter()
    for i, g in enumerate(grams):
        raw.update(set(g))
        if good.get(i):
            target.update(set(g))
    share = sum(target.values()) / sum(raw.values())
    good_share = sum(good.values()) / len(texts)
    ratio = {}
    for b, n in raw.items():
        e, t = n * share, target[b]
        ratio[b] = math.log((t + 2) / (e + 2)) if abs(t - e) > 3 * math.sqrt((e + 1) * (1 - good_share)) else 0.0
    assert any(r > 0 for r in ratio.values()) and any(r < 0 for r in ratio.values()) and any(b >= 1 << bits and r for b, r in ratio.items())
    want = np.zeros(2 << bits)
    for b, r in ratio.items():
        want[b] = r
    assert np.allclose(fit.ratios, want, atol=1e-5)
    score = [sum(n * ratio[b] for b, n in g.items()) for g in grams]
    draws = {r.id: (r.h % (1 << 52) + 0.5) / (1 << 52) for r in spark.range(900).selectExpr("id", "xxhash64(id, 42) as h").collect()}
    key = [score[i] / 0.25 - math.log(-math.log(draws[i])) for i in range(900)]
    best, cut = -1.0, None
    for c in sorted({round(score[i], 2) for i in good}):
        up = sum(good[i] and round(score[i], 2) >= c for i in good) / sum(good.values())
        down = sum(not good[i] and round(score[i], 2) < c for i in good) / (len(good) - sum(good.values()))
        if up + down > best + 1e-9:
            best, cut = up + down, c
    k = sum(s >= cut - 0.005 for s in score)
    kept = sorted(range(900), key=lambda i: -key[i])[:k]
    rows = fit.kept().collect()
    assert {r.id for r in rows} == set(kept) and fit.k == k
    for r in rows:
        assert math.isclose(r.log_ratio, score[r.id], abs_tol=1e-3) and math.isclose(r.gumbel_key, key[r.id], rel_tol=1e-4, abs_tol=1e-2)


def test_odd_documents(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "id long, good boolean")
    some = spark.createDataFrame([(1, True), (1, True), (6, False), (None, True), (2, None)], "id long, good boolean")
    every = importance.Resampler(odd_docs, none, carry=True).kept_documents()
    assert sorted(map(str, every.collect())) == sorted(map(str, odd_docs.collect()))
    kept = importance.Resampler(odd_docs, some, carry=True).kept_documents()
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3}
    assert importance.Resampler(no_docs, some, carry=True).kept_documents().count() == 0
