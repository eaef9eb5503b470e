"""Rollups whose work and memory grow with their input, and nothing else."""

import random
import time

from pyspark.sql import functions as F

from lattica.operators import rollup
from lattica.plans import trees


def brute(rows, depth):
    """(prefix) -> links, sources, top source and its links."""
    pairs = {}
    for r in rows:
        pairs.setdefault(r[:depth], {}).setdefault(r[-2], set()).add(r[-1])
    return {k: (sum(map(len, v.values())), len(v), *min(((ref, len(c)) for ref, c in v.items()), key=lambda x: (-x[1], x[0]))) for k, v in pairs.items()}


def test_parts_grow_with_the_links(spark, monkeypatch):
    monkeypatch.setattr(rollup, "TASK_ROWS", 1000)
    sizes = [rollup.extent(spark.range(n).selectExpr("id as ref")) for n in (0, 10_000, 60_000)]
    assert [s.parts for s in sizes] == [spark.sparkContext.defaultParallelism, 10, 60]
    assert [s.ref_bits for s in sizes] == [None, 14, 16]
    for ref in ("-id", "nullif(id, 3)", "9223372036854775807 - id", "cast(id as string)"):
        assert rollup.extent(spark.range(5).selectExpr(f"{ref} as ref")).ref_bits is None
    tuples = spark.range(20_000).selectExpr("id % 3 as k1", "id % 700 as ref", "id as cit")
    assert rollup.per_ref(tuples, ["k1"], [], 17).rdd.getNumPartitions() == 17


def test_rollup_of_repeated_and_unknown_keys(spark):
    """With and without one number for count and ref: tuples that repeat, keys that are null, ties."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]), rng.randrange(9), rng.randrange(12)) for _ in range(700)]
    tuples = spark.createDataFrame(rows, "k1 int, k2 string, ref long, cit long")
    want = {(d, *k, *[None] * (2 - d)): v for d in range(3) for k, v in brute(rows, d).items()}
    for size in (rollup.Extent(), rollup.Extent(3, None), rollup.extent(tuples)):
        assert {tuple(r[:3]): tuple(r[3:]) for r in rollup.rollup(tuples, ["k1", "k2"], size).collect()} == want
    assert rollup.extent(tuples).ref_bits == 4


def test_own_attributes_do_not_multiply_links(spark):
    """A work of 80 institutions and 20,000 citing works: 6,320 pairs of institutions, not 126 million tuples."""
    citing = spark.range(20_000).selectExpr("1L as ref", "id as cit")
    inst = spark.range(80).selectExpr("1L as work", "id % 4 as country", "id as inst")
    tables = {("r", "country_inst"): inst, ("r", "subfield"): spark.sql("select 1L as work, 'x' as subfield")}
    graph = trees.Graph(citing, spark.sql("select 1L as ref, 2000 as year"), tables, {"institutions": inst.select(F.col("inst").alias("entity"), "work")})
    began = time.time()
    nodes = trees.forest(graph, "institutions", 6, 1998).groupBy("depth").agg(F.count("*").alias("n"), F.min("link_count").alias("low"), F.max("link_count").alias("high")).collect()
    assert {r.depth: (r.n, r.low, r.high) for r in nodes} == {0: (80, 20_000, 20_000), 1: (320, 20_000, 20_000), 2: (320, 20_000, 20_000), 3: (6320, 20_000, 20_000)}
    assert time.time() - began < 30
