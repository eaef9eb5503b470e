"""Ranks and dense ids over tables of many partitions, on the written result and without the reuse of exchanges."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import links, ranking

N = 300_000  # rows of the tables below, in 40 blocks


@pytest.fixture()
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield spark
    spark.conf.set("spark.sql.exchange.reuse", "true")


def stored(df, folder):
    df.write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


def entities(spark, n):
    h = F.xxhash64("id")
    return spark.range(n).select("id", (F.abs(h) % 5000).alias("citations"), F.concat(F.lit("name "), h.cast("string")).alias("name"), F.lit("p").alias("part"), h.alias("nth"))


def test_ranks_of_a_large_table(no_reuse, tmp_path):
    got = stored(ranking.ranked(entities(no_reuse, N), blocks=40), tmp_path / "r")
    assert got.columns == ["id", "citations", "name", "part", "nth", "rank"]
    found = got.select("citations", "id", "name", "rank").toPandas()
    assert sorted(found["rank"]) == list(range(N))
    by_rank = found.sort_values("rank")
    order = found.sort_values(["citations", "id"], ascending=[False, True])
    assert by_rank["id"].tolist() == order["id"].tolist()
    assert (found["name"] == found["id"].map(dict(zip(order["id"], order["name"])))).all()


def test_ids_of_many_keys(no_reuse, tmp_path):
    rows = entities(no_reuse, N).select("name").unionByName(entities(no_reuse, N // 3).select("name"))
    found = stored(links.dense_ids(rows, "name", blocks=40), tmp_path / "i").toPandas().sort_values("id")
    assert found["id"].tolist() == list(range(1, N + 1))
    assert found["name"].is_monotonic_increasing


def test_empty_tied_and_null(spark):
    rows = spark.createDataFrame([(3, 5), (1, 5), (2, None), (4, 9)], "id long, citations long")
    assert [(r["id"], r["rank"]) for r in ranking.ranked(rows).orderBy("rank").collect()] == [(4, 0), (1, 1), (3, 2), (2, 3)]
    assert ranking.ranked(rows.limit(0)).collect() == []
    assert links.dense_ids(rows, "citations").orderBy("id").collect() == [(5, 1), (9, 2)]
