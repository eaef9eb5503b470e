from lattica.llm import similar_texts


def test_near_dedup_of_odd_documents(spark, odd_docs, no_docs):
    kept = similar_texts.keep_one(odd_docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, 6, 7, None]
    assert similar_texts.keep_one(no_docs).count() == 0


def test_large_groups_are_compared_band_by_band(spark, monkeypatch):
    """Whatever the tiles, the same documents stay; names like those of the operator's own columns do not matter."""
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 60, 4)] + [f"other {k} " * 9 for k in range(5)]
    docs = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in enumerate(texts)], "doc_id long, text string, words_key int, tiles string, key int")
    whole = {r.doc_id for r in similar_texts.keep_one(docs).collect()}
    tiles = similar_texts._tiles
    monkeypatch.setattr(similar_texts, "_tiles", lambda shared, scratch, most: tiles(shared, scratch, 2))
    monkeypatch.setattr(similar_texts, "HOT_TEXTS", 3)
    assert whole == {r.doc_id for r in similar_texts.keep_one(docs, tile_rows=4).collect()} == {0, 15, 16, 17, 18, 19}


def test_work_on_a_group_of_copies_grows_with_its_size(spark, monkeypatch):
    """Copies of one text meet its pivots, not each other; a text of another group among the candidates meets all."""
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(base[: k % 79] + [f"x{k}"] + base[k % 79 + 1 :]) for k in range(400)]
    texts += [" ".join(base[:40] + [f"y{j} {k}" for k in range(40)]) for j in range(30)]  # half of their words are those of the copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = []
    found = similar_texts.similar_links

    def counted(texts, *args):
        rows = spark.createDataFrame(found(texts, *args).collect(), "a long, b long")
        links.append(rows.count())
        return rows

    monkeypatch.setattr(similar_texts, "similar_links", counted)
    kept = {r.doc_id for r in similar_texts.keep_one(docs, tile_rows=16).collect()}
    assert kept == {0, *range(400, 430)} and sum(links) < 4 * 430


def test_candidates_come_from_simhash(spark, monkeypatch):
    """All texts within the radius are linked, whatever the parts; those beyond it, or of sizes too far apart, are not."""
    import numpy as np

    rng = np.random.default_rng(4)
    words = [[int(w) for w in rng.integers(0, 1 << 63, 4)] for _ in range(30)]
    rows = [(k, 100 + k, *w) for k, w in enumerate(words)]
    flip = lambda w, bits: [w[0] ^ ((1 << bits) - 1), w[1] ^ ((1 << bits) - 1), *w[2:]]
    rows += [(100 + k, 110 + k, *flip(w, 20)) for k, w in enumerate(words)] + [(200 + k, 300, *w) for k, w in enumerate(words)] + [(300, 100, words[0][0] ^ ((1 << 25) - 1 << 30), *words[0][1:])]
    prints = spark.createDataFrame(rows, "key long, size long, w0 long, w1 long, w2 long, w3 long")
    for parts in [(1024, 65_536), (3, 3)]:
        monkeypatch.setattr(similar_texts, "PRINT_ROWS", parts)
        found = similar_texts.candidate_links(prints, 0.8, 24)
        assert {frozenset(r) for r in found.collect()} == {frozenset((k, 100 + k)) for k in range(30)}
        assert similar_texts.candidate_links(prints.limit(0), 0.8, 24).count() == 0
