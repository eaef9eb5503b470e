import random

import numpy as np
import xxhash

from lattica.llm import simhash
from lattica.llm.components import connected_components
from lattica.llm._common import Scratch, forest


def naive_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = ["", "One", "one TWO", "É Ü one É", "a b c", "same " * 700] + [" ".join(rng.choice("ab cd Ef gh é".split()) for _ in range(rng.randrange(1, 900))) for _ in range(30)]
    for text in texts:
        assert simhash.fingerprint(text.encode()) == naive_fingerprint(text)


def test_links_find_all_pairs_at_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = set(base) | {0, (1 << 64) - 1, 1, 3, 7}
    for b in base[:30]:
        for _ in range(6):
            b ^= 1 << rng.randrange(64)
            values.add(b)
    values = sorted(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(5)
    i, j = np.nonzero(np.bitwise_count(np.array(values, np.uint64)[:, None] ^ np.array(values, np.uint64)[None, :]) <= 2)
    wanted = forest(len(values), i, j)
    for tile_rows in (4096, 2):
        rows = simhash.fingerprint_links(frame, 2, tile_rows).collect()
        place = {v: k for k, v in enumerate(signed)}
        assert all(bin(values[place[r.a]] ^ values[place[r.b]]).count("1") <= 64 for r in rows)
        got = forest(len(values), np.array([place[r.a] for r in rows]), np.array([place[r.b] for r in rows]))
        assert (got == wanted).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)}


def test_odd_documents(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    by_id = {}
    for r in rows:
        by_id.setdefault(r.id, set()).add((r.fp == 0, r.component))
    assert by_id[1] == {(False, 1)} and by_id[2] == {(False, 1)}
    assert by_id[3] == {(True, 3)} == by_id[4] == by_id[5]
    assert by_id[None] == {(True, 3), (False, None)}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "None"]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
