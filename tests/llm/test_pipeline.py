"""The stages of the pipeline, and run() as a whole, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import packing, similar_texts


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def survivors(rows, similarity=0.8):
    """Ids of the smallest of each group that brute force links."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or (a and b and len(a & b) / len(a | b) >= similarity):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i, _ in rows}


def corpus(seed=5):
    """Random texts, exact copies, copies with some words changed (coefficients to both sides of 0.8), chains of such, and short and empty texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([6, 9, 40, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy
    texts += [" ".join(texts[0].split()).upper(), "one", "One", "one two", "", " ", "\n"]
    order = list(range(1, len(texts) + 1))
    rng.shuffle(order)
    return list(zip(order, texts))


@pytest.mark.parametrize("tile_rows, bits", [(2048, 24), (3, 24), (2048, 3)])
def test_near_dedup_keeps_what_brute_force_keeps(spark, tile_rows, bits):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = survivors(rows)
    assert {r.doc_id for r in similar_texts.keep_one(docs, tile_rows=tile_rows, bits=bits).collect()} == want
    if tile_rows > 3:
        stage = corpus_pipeline.near_dedup(spark, docs, "")
        assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == want


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    passage = " ".join(f"b{k}" for k in range(14))
    rows = [(i, t, "en", "s", len(t)) for i, t in corpus(9)]
    n = len(rows)
    long = " ".join(f"x{rng.randrange(9999)}" for _ in range(80))
    rows += [(n + 1, f"{long} {passage}", "en", "s", 0), (n + 2, passage, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")  # without labels all pass the first stage
    kept = survivors([(r[0], r[1]) for r in rows]) - {n + 2}
    want = [(i, f"{long} " if i == n + 1 else t) for i, t, *_ in rows if i in kept]
    pieces = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "length", "ids_crc32").collect())
    tokens = packing.tokenize_pieces(spark.createDataFrame(want, "doc_id long, text string"), corpus_pipeline.tokenizer_path())
    tokens = tokens.select(F.col("id").alias("doc_id"), "piece", "length", F.crc32("ids").alias("ids_crc32"))
    assert pieces(corpus_pipeline.run(spark, str(tmp_path))) == pieces(tokens)


def test_stages_with_labels_secrets_and_odd_rows(spark, tmp_path):
    """Each stage by itself: labelled bad texts go, a secret is masked, null, empty, long and repeated rows pass, and columns of any name stay."""
    rng = random.Random(3)
    good = [" ".join(rng.choice(["river", "stone", "meadow", "cloud", "walk", "light"]) for _ in range(60)) for _ in range(120)]
    bad = [" ".join(rng.choice(["buy", "cheap", "pills", "click", "now", "winner"]) for _ in range(60)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (902, "river stone " * 40_000), (903, "password = hunter2secret river stone"), (903, "password = hunter2secret river stone")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 2, True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, words_key int, key string, cut_text int, hit boolean")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, str(tmp_path))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and not [i for i in ids if 120 <= i < 240] and len([i for i in ids if i < 120]) >= 114
    near = stages["SimHash near-dedup"](spark, docs, str(tmp_path))
    found = sorted(r.doc_id for r in near.select("doc_id").collect())
    assert near.columns == docs.columns and [i for i in found if i >= 900] == [900, 902, 903]
    clean = stages["benchmark decontamination"](spark, near, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == near.count()
    masked = stages["secret scans"](spark, clean, str(tmp_path))
    text = masked.filter("doc_id = 903").first().text
    assert masked.columns == docs.columns and "hunter2secret" not in text and "river stone" in text
    assert masked.filter("doc_id = 900").first().text is None
    packed = stages["best-fit packing"](spark, masked, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(found)
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
