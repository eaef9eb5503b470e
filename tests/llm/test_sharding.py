import random
import zlib

from lattica.llm import sharding


def naive_best_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= sizes[i] and room > 0]
        if fits:
            _, k = min(fits)
        else:
            rooms.append(capacity)
            k = len(rooms) - 1
        rooms[k] = rooms[k] - sizes[i] if rooms[k] > sizes[i] else 0
        out[i] = k
    return out


def test_tree_packs_as_a_plain_search_does():
    rng = random.Random(3)
    for _ in range(40):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 120))]
        assert sharding.best_fit_decreasing(sizes, 50) == naive_best_fit(sizes, 50)


def test_pack_into_uses_no_more_bins():
    rng = random.Random(4)
    for _ in range(20):
        sizes = [rng.randrange(1, 1000) for _ in range(200)]
        where = sharding.pack_into(sizes, 8)
        loads = [sum(s for s, w in zip(sizes, where) if w == k) for k in range(8)]
        assert max(where) < 8 and max(loads) <= 1.02 * sum(sizes) / 8 + 1
    assert sharding.pack_into([], 8) == [] and max(sharding.pack_into([5, 1, 1], 8)) < 8


def test_shards_keep_groups_and_balance(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "ü"]) for _ in range(rng.randrange(1, 400))) for _ in range(1500)] + ["copied text of some length"] * 900
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for units in (4096, 32):
        got = sharding.shard(docs, 8, units=units).collect()
        assert sorted(r.id for r in got) == list(range(len(texts)))
        group, loads, slots = {}, [0] * 8, {}
        for r in got:
            text = texts[r.id]
            assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
            assert group.setdefault(text, r.shard) == r.shard
            loads[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(loads) - min(loads) < 0.1 * sum(loads) / 8


def test_odd_documents(odd_docs, no_docs):
    got = sharding.shard(odd_docs).collect()
    assert len(got) == 10
    assert len({r.shard for r in got if r.id in (1, 2)}) == 1
    assert {(r.size, r.text_crc32) for r in got if r.id in (3, 4)} == {(1, 0)}
    slots = sorted((r.shard, r.slot) for r in got)
    assert len(set(slots)) == 10
    assert sharding.shard(no_docs).count() == 0
