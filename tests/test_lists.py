"""Counts as arrays, and how much the forests that use them shuffle."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from lattica.operators import lists, rollup
from lattica.plans import entities, trees


def shuffled_rows(spark, frame):
    """Rows that the frame's stages write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = total()
    rows = frame.collect()
    return rows, total() - before


def test_counts_of_many_batches(spark):
    """Refs of many rows, numbers beyond one list, counts beyond a byte; unknown refs have none."""
    rng = random.Random(5)
    rows = [(ref, rng.sample(range(9000), 30) + [0, 4095, 4096]) for ref in rng.choices([0, 1, 2, 3, 70], [1, 5, 50, 200, 1], k=600)]
    want = Counter((ref, x) for ref, own in rows for x in own)
    frame = spark.createDataFrame([*rows, (None, [1])], "ref long, own array<int>")
    got = lists.each_count(lists.count_lists(frame, 3))
    assert {tuple(r[:2]): r[2] for r in got.select("ref", "__p", "n").collect()} == want and max(want.values()) > 127
    single = lists.each_count(lists.count_lists(frame.select("ref", F.explode("own").alias("own")), 3))
    assert {tuple(r[:2]): r[2] for r in single.select("ref", "__p", "n").collect()} == want
    rows.sort()
    for size in (1, 7, 600):
        batches = [pa.RecordBatch.from_pydict({"ref": [r for r, _ in rows[i : i + size]], "own": pa.array([o for _, o in rows[i : i + size]], pa.list_(pa.int16()))}) for i in range(0, len(rows), size)]
        found = [(r["ref"], (r["of"] << 4) + p, n) for b in lists.lister(4)(iter(batches)) for r in b.to_pylist() for p, n in zip(r["near"] or r["far"], r["small"] or r["large"])]
        assert Counter({(ref, x): n for ref, x, n in found}) == want and len(found) == len(want)


def test_slim_arrays(spark):
    """Arrays of longs come back whole, be they of ints or not; those of texts too."""
    rows = [(1, [1, 2, 2]), (2, [1 << 40, 3]), (3, [-1]), (4, []), (5, None), (6, [(1 << 31) - 1])]
    for kind, value in (("long", lambda x: x), ("string", str)):
        frame = spark.createDataFrame([(k, None if v is None else [value(x) for x in v]) for k, v in rows], f"id int, v array<{kind}>")
        packed = lists.slim(frame, "v")
        assert [tuple(r) for r in packed.select("id", lists.unslim(packed).alias("v")).orderBy("id").collect()] == [tuple(r) for r in frame.orderBy("id").collect()]
        assert packed.filter("slim is not null").count() == (2 if kind == "long" else 0)


def test_prime_lists_shuffle_works_of_entities_not_what_they_have(spark, monkeypatch):
    """1,000 works, each of 20 entities that are its authors and of 40 countries: some 20,000 rows twice and 40,000 tables' rows, not 800,000 counts and 380,000 pairs."""
    monkeypatch.setattr(rollup, "TASK_ROWS", 25)
    author = spark.range(20_000).selectExpr("id div 20 as work", "(id * 7919) % 2003 as author").distinct()
    one = spark.range(1000).selectExpr("id as work", "id % 3 as k")
    tables = {("r", "author"): author, ("r", "country"): spark.range(40_000).selectExpr("id div 40 as work", "id % 40 as country"), ("c", "subfield"): one.selectExpr("work", "k as subfield")}
    tables |= {("r", col): one.withColumnRenamed("k", col) for col in ("subfield", "topic", "source")}
    graph = trees.Graph(one.selectExpr("work as ref", "(work + 1) % 1000 as cit"), one.selectExpr("work as ref", "2000 as year"), tables, {"authors": author.selectExpr("author as entity", "work")})
    found, rows = shuffled_rows(spark, entities.prime_lists(graph, "authors", spark.sql("select 1L as source, 5L as value")))
    mine, people = {}, {}
    for r in author.collect():
        mine.setdefault(r.author, []).append(r.work)
        people.setdefault(r.work, []).append(r.author)
    best = {(r.entity, r["rank"]): (r.related, r.score) for r in found if r.rel_type == 5}
    for entity in (0, 5, 1999):
        shared = Counter(a for w in mine[entity] for a in people[w] if a != entity)
        h = {a: next((k for k in range(n) if n * (1 >= k) <= k), n) for a, n in shared.items()}  # every work is cited once
        assert [best[entity, k] for k in range(1, 6)] == [(str(a), h[a]) for a in sorted(h, key=lambda a: (-h[a], a))[:5]]
    assert {(r.related, r.score) for r in found if r.rel_type == 3 and r.entity == 5} == {(str(k), len(mine[5])) for k in range(3)}
    assert rows < 300_000


def test_forest_shuffles_works_of_members_not_their_prefixes(spark, monkeypatch):
    """2,000 members of 10 works each, whose citing works are of 25 countries: some 20,000 rows and 56,000 nodes, not 560,000 counts."""
    monkeypatch.setattr(rollup, "TASK_ROWS", 500)
    member = spark.range(20_000).selectExpr("id % 2000 as inst", "id as work")
    citing = spark.range(20_000).selectExpr("id as ref", "id % 50 as cit")
    tables = {
        ("r", "inst_country"): spark.range(2000).selectExpr("id as inst", "id % 3 as country"), ("r", "source"): member.selectExpr("work", "inst as source"),
        ("r", "subfield"): member.selectExpr("work", "'x' as subfield"), ("c", "country"): spark.range(1250).selectExpr("id % 50 as work", "id div 50 as country"),
    }
    graph = trees.Graph(citing, member.selectExpr("work as ref", "2000 as year"), tables, {"institutions": member.selectExpr("inst as entity", "work")})
    nodes, rows = shuffled_rows(spark, trees.forest(graph, "countries", 2, 1998))
    assert Counter(r.depth for r in nodes) == {0: 3, 1: 2000, 2: 2000, 3: 2000, 4: 50_000}
    assert {(r.link_count, r.source_count, r.top_source_links) for r in nodes if r.depth} == {(10, 10, 1)}
    assert rows < 300_000
