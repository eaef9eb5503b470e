"""Works with very many attributes, entities with very many authors."""

import random
import time

from lattica.operators import stats
from lattica.plans import entities, trees


def test_citing_work_of_many_institutions(spark):
    """Prefixes are compared as numbers, so work is linear in a citing work's institutions; unknown levels are values."""
    n = 30_000
    citing = spark.sql("select 1L as ref, 5L as cit union all select 2L, 5L union all select 2L, 6L")
    inst = spark.range(n).selectExpr("5L as work", "nullif(id % 4, 3) as country", "nullif(id, 0) as inst").unionByName(spark.sql("select 6L as work, 0L as country, cast(null as long) as inst"))
    tables = {("c", "country_inst"): inst, ("c", "source"): spark.sql("select 5L as work, 9L as source union all select 6L, 9L"), ("r", "subfield"): spark.sql("select id as work, 'x' as subfield from range(1, 3)")}
    graph = trees.Graph(citing, spark.sql("select id as ref, 2000 as year from range(1, 3)"), tables, {"sources": spark.sql("select 2L as entity, id as work from range(1, 3)")})
    began = time.time()
    nodes = {tuple(r[:5]): tuple(r[5:]) for r in trees.tree(graph, "sources", 2, 0, 1998).filter("depth < 3 or k3 is null or k3 = 4").collect()}
    assert time.time() - began < 40
    assert nodes[0, None, None, None, None] == nodes[1, "x", None, None, None] == (3, 2, 2, 2)
    assert nodes[2, "x", 0, None, None] == nodes[3, "x", 0, None, None] == nodes[4, "x", 0, None, 9] == (3, 2, 2, 2)
    assert nodes[2, "x", None, None, None] == nodes[4, "x", 0, 4, 9] == (2, 2, 1, 1)
    assert len(nodes) == 1 + 1 + 4 + 2 + 2


def test_h_of_groups(spark):
    rng = random.Random(3)
    sizes = [rng.choice([1, 2, 7, 8, 9, 40]) for _ in range(300)]
    rows = [(g, rng.choice([0, 1, 6, 7, 8, 9, 30, rng.randrange(50)])) for g, size in enumerate(sizes) for _ in range(size)]
    counts = spark.createDataFrame(rows, "g long, c long")
    want = sorted(map(tuple, stats.h_and_median(counts, ["g"]).select("g", "h").collect()))
    assert {h for _, h in want} > {1, 7, 8, 9}
    for low in (1, 2, 8, 60):
        assert sorted(map(tuple, stats.h_of_groups(counts, ["g"], low).collect())) == want


def test_authors_in_blocks_of_an_entity(spark, monkeypatch):
    """The best of the blocks are those of the whole."""
    from lattica import queries

    tables = queries.Tables(spark, "/root/testdata/sf0.001")
    once = sorted(map(tuple, queries.prime_lists(tables).collect()))
    monkeypatch.setattr(entities, "ENTITY_WORKS", 7)
    assert sorted(map(tuple, queries.prime_lists(tables).collect())) == once
