"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on node ids; hubs are met by partial minima, and the joins are
plain equi-joins that adaptive execution may split. Every round is written to the shared folder and the one
before it deleted, so neither lineage nor disk grows with the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges here run from the larger to the smaller id."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of an edge (a, b); component is the smallest node id reachable.

    Edges may repeat, be loops or come in either direction. Nodes without a link to another are absent:
    they are their own component. No edges: no rows. Null ends are ignored.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    known, turn = None, 0
    current = scratch.put(edges.distinct(), f"{tag}0")
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == known or not mark[0]:
            break
        known, turn = tuple(mark), turn + 1
        following = scratch.put(_small_star(_large_star(current)), f"{tag}{turn}")
        scratch.drop(f"{tag}{turn - 1}")
        current = following
    root = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(root)
