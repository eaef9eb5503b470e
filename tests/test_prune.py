"""Pruning against a plain walk down the tree, with thousands of children, ties, unknown children and many trees at once."""

import random

import pytest

from lattica.operators import prune

SCHEMA = "root long, depth int, k1 long, k2 long, link_count long, source_count long"


def forest(rng, roots, wide):
    rows = []
    for root in range(roots):
        rows.append((root, 0, None, None, 10_000, 5))
        for a in [None, *range(rng.choice([3, 15, 16, wide]))]:
            rows.append((root, 1, a, None, rng.randint(1, 40), rng.randint(1, 9)))
            for b in rng.choice([[], [None], [None, *range(15)], [None, *range(16)], range(16), range(wide)]):
                rows.append((root, 2, a, b, rng.randint(1, 40), rng.randint(1, 9)))
    return rows


def best(children, key, spec, siblings=16):
    if len(children) <= siblings:
        return children
    known = [r for r in children if key(r) is not None]
    by_links = sorted(known, key=lambda r: (-r[4], -key(r)))[:siblings]
    by_spec = sorted(known, key=lambda r: (-spec(r), -key(r)))[:siblings]
    return list(dict.fromkeys(by_links + by_spec))


def brute(rows, baseline):
    """Level 1 by its share of the root, level 2 by its share of level 1 over the baseline."""
    out = []
    for top in (r for r in rows if r[1] == 0):
        out.append(top)
        for node in best([r for r in rows if r[0] == top[0] and r[1] == 1], lambda r: r[2], lambda r: r[4] / top[4]):
            out.append(node)
            below = [r for r in rows if r[0] == top[0] and r[1] == 2 and r[2] == node[2]]
            out += best(below, lambda r: r[3], lambda r: r[4] / node[4] / baseline.get(r[3], 1.0))
    return out


@pytest.mark.parametrize("roots", [1, 4])
def test_equals_a_walk_down_the_tree(spark, roots):
    rng = random.Random(roots)
    rows = forest(rng, roots, 300)
    baseline = {k: rng.choice([0.5, 1.0, 2.0, 0.25]) for k in range(0, 300, 2)}
    tree = spark.createDataFrame(rows, SCHEMA)
    base = spark.createDataFrame(list(baseline.items()), "key long, baseline double")
    if roots == 1:
        got = [(0, *r) for r in prune.prune(tree.drop("root"), ["k1", "k2"], [0, 1], {1: base}).collect()]
    else:
        got = [tuple(r) for r in prune.prune(tree, ["k1", "k2"], [0, 1], {1: base}, by=("root",)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, baseline), key=repr)


def test_larger_levels_are_joined_as_tables(spark, monkeypatch):
    rows = [r[1:] for r in forest(random.Random(9), 1, 40)]
    tree = spark.createDataFrame(rows, SCHEMA.replace("root long, ", ""))
    once = sorted(map(tuple, prune.prune(tree, ["k1", "k2"], [0, 0]).collect()), key=repr)
    monkeypatch.setattr(prune, "HELD_NODES", 0)
    assert sorted(map(tuple, prune.prune(tree, ["k1", "k2"], [0, 0]).collect()), key=repr) == once


def test_at_most_two_exchanges_a_level(spark):
    tree = spark.createDataFrame([r[1:] for r in forest(random.Random(2), 1, 40)], SCHEMA.replace("root long, ", ""))
    children = tree.filter("depth = 2").selectExpr("*", "link_count / 3 as __spec")
    plan = prune._best(children, ["k1"], "k2", 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
