import numpy as np
import pytest

from lattica.llm import embedding
from lattica.llm._common import forest


def brute(ids, vectors, threshold):
    ok = np.array([v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors])
    n = len(ids)
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.float32(vectors[i]).astype(float), np.float32(vectors[j]).astype(float)
                links[i, j] = links[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    label = forest(n, *np.nonzero(links))
    least = [min(ids[k] for k in range(n) if label[k] == label[i]) for i in range(n)]
    return [(ids[i], int(links[i].sum()), least[i], ids[i] == least[i]) for i in range(n)]


@pytest.mark.parametrize("leaf_values", [1 << 21, 320, 48])
def test_links_match_brute_force(spark, leaf_values):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(150, 16))
    near = base[rng.integers(0, 40, 120)] + 0.05 * rng.normal(size=(120, 16))
    rows = [v.tolist() for v in np.concatenate([base, near, near[:30], 3 * base[:10]])]
    rows += [[0.0] * 16, None, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] + [0.0] * 15, [], [1.0, 2.0], [2.0, 4.0], [-0.0] * 15 + [1.0], [0.0] * 15 + [1.0]]
    ids = rng.permutation(len(rows)).tolist()
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids, rows)], "vec_id long, embedding array<float>, key string, uid int").repartition(4)
    got = embedding.near_duplicates(frame, 0.95, n_blocks=4, leaf_values=leaf_values).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(ids, rows, 0.95))


def test_copies_and_no_rows(spark):
    frame = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (8, None)], "vec_id long, embedding array<double>")
    got = sorted((str(r.id), r.n_links, r.component, r.kept) for r in embedding.near_duplicates(frame).collect())
    assert got == [("3", 3, 3, True), ("3", 3, 3, True), ("5", 3, 3, False), ("8", 0, 8, True), ("None", 3, 3, False)]
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


def test_reach_finds_all_leaves_within_the_limit():
    rng = np.random.default_rng(11)
    points = np.round(rng.normal(size=(900, 3)), 1).astype(np.float32)  # many ties
    tree = embedding.Halves(points, 5)
    assert sorted(np.concatenate(tree.held)) == list(range(900))
    visited = {leaf: set(rows) for leaf, rows in tree.reach(points, 0.2)}
    leaf_of = np.zeros(900, int)
    for leaf, rows in enumerate(tree.held):
        leaf_of[rows] = leaf
    home = tree.home(points)
    for i in range(900):
        assert i in visited[home[i]] and i in visited[leaf_of[i]]
        for j in np.flatnonzero(((points - points[i]) ** 2).sum(axis=1) <= 0.199):
            assert i in visited[leaf_of[j]] and i in visited[home[j]]


def test_one_of_two_leaves_visits_the_other():
    a, b = np.meshgrid(np.arange(9), np.arange(9))
    assert (embedding._visits(a, b) ^ embedding._visits(b, a) == (a != b)).all()


def test_many_cells_match_brute_force(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1500, 16))
    rows = np.concatenate([base, base[:500] + 0.07 * rng.normal(size=(500, 16))]).astype(np.float32)
    unit = rows.astype(float) / np.sqrt((rows.astype(float) ** 2).sum(axis=1, keepdims=True))
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    frame = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<float>").repartition(3)
    got = {r.id: r.n_links for r in embedding.near_duplicates(frame, n_blocks=2).collect()}
    assert got == dict(enumerate(links.tolist()))
