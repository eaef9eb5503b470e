"""Standardised features and nearest neighbours.

Neighbours of all entities at once: the distinct points of the plane are cut into cells of equal numbers, strips by the first feature,
each cut by the second. A cell that holds n entities bounds the distance to a point's n-th neighbour by its farthest corner, so a
point visits only the cells that the least such circle meets, and each cell compares its own points with its visitors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import impact_features
from ..scratch import written
from .ranking import numbered

#: Cells at most; their corners are broadcast, 40 bytes each.
MOST_CELLS = 1 << 20
#: A point that more entities share than this number and this share of all is joined by broadcast; fewer than one over the share exist.
HOT_ROWS, HOT_SHARE = 1000, 1024


def standardized(entities: DataFrame) -> DataFrame:
    """(id, f1, f2): z-scores (population deviation) of log citations and citations a paper; 0 where all are alike."""
    f1, f2 = impact_features(F.col("papers"), F.col("citations"))
    rows = entities.select("id", f1.alias("f1"), f2.alias("f2"))
    stats = rows.agg(*[g(c).alias(f"{n}_{c}") for c in ("f1", "f2") for n, g in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.when(F.col(f"s_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c)
    return rows.join(F.broadcast(stats), F.lit(True)).select("id", z("f1"), z("f2"))


def nearest(features: DataFrame, entity: int, n: int) -> DataFrame:
    """(id, distance): the n nearest others by Euclidean distance, ties to the lower id."""
    here = features.filter(F.col("id") == entity).select(F.col("f1").alias("x1"), F.col("f2").alias("x2")).limit(1)
    distance = F.sqrt(F.pow(F.col("f1") - F.col("x1"), F.lit(2)) + F.pow(F.col("f2") - F.col("x2"), F.lit(2)))
    return features.filter(F.col("id") != entity).join(F.broadcast(here), F.lit(True)).select("id", distance.alias("distance")).orderBy("distance", "id").limit(n)


def neighbourhood_size(n_entities: int) -> int:
    return min(n_entities // 20, 500)


def _cells(points: DataFrame, n: int) -> tuple[DataFrame, int, int]:
    """(cell, key, f1, f2, ids), strips, cells a strip: points in cells of about equal numbers, at least n where there are as many; cells of a
    strip follow each other."""
    n_points = points.count()
    cells = max(1, min(MOST_CELLS, n_points // max(n, 64)))
    strips = math.isqrt(cells)
    each = cells // strips
    strip = F.expr(f"cast(key * {strips} div {max(1, n_points)} as long)")
    by_first = numbered(points, [F.col("f1"), F.col("f2")], "key").withColumn("strip", strip)
    by_second = numbered(by_first, [F.col("strip"), F.col("f2"), F.col("f1")], "key")
    start = lambda s: F.expr(f"({s} * {n_points} + {strips - 1}) div {strips}")
    slot = F.expr(f"(key - first) * {each} div (past - first)")
    placed = by_second.withColumn("first", start("strip")).withColumn("past", start("(strip + 1)"))
    return placed.select((F.col("strip") * each + slot).cast("int").alias("cell"), "key", "f1", "f2", "ids"), strips, each


def _visits(boxes: np.ndarray, strips: int, each: int, n: int):
    """Which cells a point has to look into: rows (cell, key, f1, f2, reach), ``reach`` the square of a distance within which n entities lie."""
    low1, high1, low2, high2, size = (boxes[:, k].reshape(strips, each) for k in range(5))

    def run(batches):
        for batch in batches:
            x, y, key = (batch.column(c).to_numpy() for c in ("f1", "f2", "key"))
            reach = np.full(len(x), np.inf)
            for s in range(strips):
                at = np.clip(np.searchsorted(low2[s], y, "right") - 1, 0, each - 1)
                far1 = np.maximum(x - low1[s, at], high1[s, at] - x)
                far2 = np.maximum(y - low2[s, at], high2[s, at] - y)
                enough = size[s, at] >= n
                reach[enough] = np.minimum(reach[enough], (far1 * far1 + far2 * far2)[enough])
            radius = np.sqrt(reach) * (1 + 1e-9)
            for s in range(strips):
                near = np.flatnonzero((x - radius <= high1[s].max()) & (x + radius >= low1[s].min()))
                first = np.searchsorted(high2[s], y[near] - radius[near], "left")
                n_cells = np.maximum(np.searchsorted(low2[s], y[near] + radius[near], "right") - first, 0)
                who = np.repeat(near, n_cells)
                cell = np.arange(len(who)) - np.repeat(np.cumsum(n_cells) - n_cells - first, n_cells)
                gap1 = np.maximum(np.maximum(low1[s, cell] - x[who], x[who] - high1[s, cell]), 0)
                gap2 = np.maximum(np.maximum(low2[s, cell] - y[who], y[who] - high2[s, cell]), 0)
                in_reach = gap1 * gap1 + gap2 * gap2 <= radius[who] ** 2
                who, cell = who[in_reach], cell[in_reach]
                if len(who):
                    yield pa.RecordBatch.from_pydict({"cell": pa.array((s * each + cell).astype(np.int32)), "key": key[who], "f1": x[who], "f2": y[who], "reach": radius[who] ** 2})

    return run


def _nearest_in_cell(n: int):
    """For each visitor of a cell the n nearest entities there within its reach, as (distance squared, id)."""

    def run(hosts: pa.Table, visitors: pa.Table) -> pa.Table:
        hosts = hosts.combine_chunks()
        x, y = (hosts.column(c).to_numpy() for c in ("f1", "f2"))
        lists = hosts.column("ids").combine_chunks()
        ids, counts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(x)), counts)
        first = np.concatenate([[0], np.cumsum(counts)])
        sizes, found, squares = [], [], []
        qx, qy, reach = (visitors.column(c).to_numpy() for c in ("f1", "f2", "reach"))
        for a, b, most in zip(qx, qy, reach):
            d1, d2 = x - a, y - b
            square = d1 * d1 + d2 * d2
            near = np.flatnonzero(square <= most)
            if counts[near].sum() > n:  # the entities of the nearest points that make up n, ties included
                near = near[np.argsort(square[near], kind="stable")]
                enough = square[near[np.searchsorted(np.cumsum(counts[near]), n)]]
                near = near[square[near] <= enough]
            which = np.concatenate([np.arange(first[k], first[k + 1]) for k in near]) if len(near) else np.zeros(0, np.int64)
            which = which[np.lexsort((ids[which], square[owner[which]]))][:n]
            sizes.append(len(which))
            found.append(ids[which])
            squares.append(square[owner[which]])
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *squares])), pa.array(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64))], ["square", "id"])
        near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
        return pa.table({"key": visitors.column("key"), "near": near})

    return run


def neighbour_pools(features: DataFrame, n: int) -> DataFrame:
    """(f1, f2, entities, near) of every distinct point of (id, f1, f2): ``near`` has (square, id) of the ``n`` entities nearest to it, those at the
    point itself included, nearest first, ties to the lower id; ``square`` is the distance squared, ``entities`` how many lie at the point.

    Entities with a null or NaN feature lie nowhere. Of entities at one point only the n lowest ids can be among the nearest of any; they
    are found by a limit within each partition before the shuffle, so that a point that many share makes no large group. All
    entities have a pool of fewer than n only where there are fewer entities. n below 1: no rows.
    """
    known = features.filter("f1 is not null and f2 is not null and not isnan(f1) and not isnan(f2)").select(F.col("id").cast("long").alias("id"), "f1", "f2")
    if n < 1:
        return known.limit(0).select("f1", "f2", F.lit(0).cast("long").alias("entities"), F.array(F.struct(F.lit(0.0).alias("square"), "id")).alias("near"))
    place = F.row_number().over(Window.partitionBy("f1", "f2").orderBy("id"))
    lowest = known.withColumn("place", place).filter(F.col("place") <= n).groupBy("f1", "f2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    cells, strips, each = _cells(written(lowest, "points"), n)
    cells = written(cells, "cells")
    edges = cells.groupBy("cell").agg(F.min("f1"), F.max("f1"), F.min("f2"), F.max("f2"), F.sum(F.size("ids"))).orderBy("cell").collect()  # at most MOST_CELLS
    if not edges:
        return known.limit(0).select("f1", "f2", F.lit(0).cast("long").alias("entities"), F.array(F.struct(F.lit(0.0).alias("square"), "id")).alias("near"))
    boxes = np.array([r[1:] for r in edges], dtype=float)
    shared = features.sparkSession.sparkContext.broadcast(boxes)

    def visit(batches):
        return _visits(shared.value, strips, each, n)(batches)

    visits = cells.select("key", "f1", "f2").mapInArrow(visit, "cell int, key long, f1 double, f2 double, reach double")
    parts = cells.select("cell", "f1", "f2", "ids").groupBy("cell").cogroup(visits.groupBy("cell")).applyInArrow(_nearest_in_cell(n), "key long, near array<struct<square: double, id: bigint>>")
    pools = parts.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, n).alias("near"))
    count = known.groupBy("f1", "f2").agg(F.count("*").alias("entities"))
    return pools.join(cells.select("key", "f1", "f2"), "key").join(count, ["f1", "f2"]).select("f1", "f2", "entities", "near")


def with_pools(features: DataFrame, pools: DataFrame) -> DataFrame:
    """(id, near) of every entity that lies somewhere; points that many entities share are met by broadcast."""
    pools = written(pools, "pools")
    total = pools.agg(F.sum("entities")).first()[0] or 0
    hot = F.col("entities") > max(HOT_ROWS, total // HOT_SHARE)
    rows = features.select(F.col("id").cast("long").alias("id"), "f1", "f2")
    large = F.broadcast(pools.filter(hot).select("f1", "f2", "near"))
    rest = rows.join(large, ["f1", "f2"], "left_anti").join(pools.filter(~hot).select("f1", "f2", "near"), ["f1", "f2"])
    return rows.join(large, ["f1", "f2"]).unionByName(rest).select("id", "near")


def similar_entities(features: DataFrame, n: int, most: int = 8, seed: int = 0) -> DataFrame:
    """(id, similar): of each entity's ``n`` nearest, itself among them, ``most`` drawn by the MD5 of "seed:id:other", in that order, without itself."""
    pooled = with_pools(features, neighbour_pools(features, n))
    drawn = F.transform("near", lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), x["id"].cast("string"))).alias("draw"), x["id"].alias("id")))
    first = F.transform(F.slice(F.array_sort(drawn), 1, most), lambda x: x["id"])
    return pooled.select("id", F.filter(first, lambda x: x != F.col("id")).alias("similar"))
