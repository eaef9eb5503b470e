"""Nearest neighbours of all entities against all pairs in numpy, with shared points, lines, outliers and one dense cluster."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from lattica.operators import similar


def brute(ids, x, y, n):
    out = {}
    for i, a, b in zip(ids, x, y):
        d = (x - a) * (x - a) + (y - b) * (y - b)
        out[i] = ids[np.lexsort((ids, d))][:n].tolist()
    return out


def planes():
    rng = np.random.default_rng(5)
    yield "even", rng.random(3000), rng.random(3000)
    yield "dense and far", np.concatenate([rng.normal(0, 1e-3, 2500), rng.normal(5, 40, 500)]), np.concatenate([rng.normal(0, 1e-3, 2500), rng.normal(-9, 40, 500)])
    yield "shared points", np.where(rng.random(3000) < 0.4, 1.0, rng.integers(0, 12, 3000)), np.where(rng.random(3000) < 0.4, 2.0, rng.integers(0, 15, 3000))
    yield "line", np.zeros(3000), rng.random(3000)
    yield "few", rng.random(7), rng.random(7)


@pytest.mark.parametrize("name,x,y,n", [(*p, 1 if p[0] == "even" else 70) for p in planes()], ids=[p[0] for p in planes()])
def test_pools_equal_all_pairs(spark, name, x, y, n):
    x, y = np.asarray(x, float), np.asarray(y, float)
    ids = np.random.default_rng(1).permutation(len(x)).astype(np.int64)
    features = spark.createDataFrame(pd.DataFrame({"id": ids, "f1": x, "f2": y}))
    got = similar.with_pools(features, similar.neighbour_pools(features, n)).collect()
    assert {r["id"]: [e["id"] for e in r["near"]] for r in got} == brute(ids, x, y, n)


def test_hot_points_are_met_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(similar, "HOT_ROWS", 5)
    ids = np.arange(400)
    x, y = np.where(ids % 3 == 0, 1.0, ids / 7.0), np.where(ids % 3 == 0, 1.0, ids % 11)
    features = spark.createDataFrame(pd.DataFrame({"id": ids, "f1": x, "f2": y}))
    got = similar.with_pools(features, similar.neighbour_pools(features, 20)).collect()
    assert {r["id"]: [e["id"] for e in r["near"]] for r in got} == brute(ids, x, y, 20)


def test_sample_is_drawn_by_seed(spark):
    ids = np.arange(300)
    x, y = ids / 10.0, (ids * 37 % 50) / 5.0
    features = spark.createDataFrame(pd.DataFrame({"id": ids, "f1": x, "f2": y}))
    pools = brute(ids, x, y, 15)
    draw = lambda i: sorted(pools[i], key=lambda o: hashlib.md5(f"3:{i}:{o}".encode()).hexdigest())[:8]
    got = similar.similar_entities(features, 15, 8, seed=3).collect()
    assert {r["id"]: r["similar"] for r in got} == {i: [o for o in draw(i) if o != i] for i in ids.tolist()}


def test_nothing_and_nowhere(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1.0, 1.0)], "id long, f1 double, f2 double")
    pools = similar.neighbour_pools(rows, 5)
    assert sorted((r["id"], [e["id"] for e in r["near"]]) for r in similar.with_pools(rows, pools).collect()) == [(1, [1, 4]), (4, [4, 1])]
    assert similar.neighbour_pools(rows, 0).collect() == [] and similar.neighbour_pools(rows.limit(0), 3).collect() == []
    alike = spark.createDataFrame([(i, 3, 5) for i in range(4)], "id long, papers long, citations long")
    assert {(r["f1"], r["f2"]) for r in similar.standardized(alike).collect()} == {(0.0, 0.0)}
