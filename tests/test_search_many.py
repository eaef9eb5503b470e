"""A table of queries against the stored index, held against the search of each query by itself."""

import random

from lattica.operators import search
from lattica.scratch import new_folder


def one_by_one(spark, names, texts):
    index = search.build_index(names).cache()
    out = [(t, k + 1, r["rank"], r["partial"]) for t in texts for k, r in enumerate(search.search(index, t).collect())]
    index.unpersist()
    return out


def both(spark, names, texts):
    frame = spark.createDataFrame(list(enumerate(names)), "rank long, name string")
    folder = new_folder(spark, "index")
    search.store_index(frame, folder)
    queries = spark.createDataFrame([(t, t) for t in texts], "query string, text string")
    got = [tuple(r) for r in search.search_many(spark, folder, queries).collect()]
    assert sorted(got) == sorted(one_by_one(spark, frame, texts))


def test_equals_search_query_by_query(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aabcn") for _ in range(rng.choice([1, 2, 2, 3, 4, 5, 7])))
    names = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(150)] + ["", None, "123", "Ânna-bc a"]
    texts = ["", "a", "z", "ab", "bcn", "anac", "a b", "ab n", "ab a c", "bc aa", "aab bc n", "a ab", "zz ab", "cab ba aa bb", "Ab, C!"]
    both(spark, names, sorted({*texts, *[" ".join(word() for _ in range(rng.choice([1, 2, 3]))) for _ in range(4)]}))


def test_only_folders_of_the_queries_are_read(spark):
    folder = new_folder(spark, "index")
    search.store_index(spark.createDataFrame([(0, "red plate"), (1, "old rod")], "rank long, name string"), folder)
    found = search.search_many(spark, folder, spark.createDataFrame([(1, "re pla"), (2, "ro"), (2, "ro"), (3, None)], "query long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [letters" in plan and "CartesianProduct" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 0, 1), (2, 1, 1, 1), (3, 1, 0, 0), (3, 2, 1, 0)]
