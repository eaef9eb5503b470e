"""Pruning of rollup trees to the largest and the most over-represented children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Kept nodes of a level that come to the driver and go out as a broadcast, if their number cannot be larger; else they are a table.
HELD_NODES = 1 << 12
#: In how many parts a node's children are ranked at first, so that none of many children fills a task.
PARTS = 32


def prune(
    tree: DataFrame, keys: list[str], denominators: list[int], baselines: dict[int, DataFrame] | None = None, siblings: int = 16, by: tuple[str, ...] = (),
) -> DataFrame:
    """Keep, under every kept node, the union of its ``siblings`` largest and ``siblings`` most specialised children.

    ``denominators[d]`` is the depth whose link count divides that of a child on level d; ``baselines[d]`` is a frame (key, baseline)
    for level d, 1.0 where there is none. Up to ``siblings`` children all stay; beyond, the unknown child (null) goes first. Ties
    go to the higher key. Measures do not change. With columns ``by`` the frame has a tree for each of their values.

    The tree is stored once. A level is read for the children of kept nodes alone, ranked in two steps by both orders together: parts of
    a node's children first, then the best of the parts. A single tree keeps at most ``(2 * siblings) ** depth`` nodes on a level, which
    bounds what is broadcast; larger levels and those of many trees are stored and joined.
    """
    tree = written(tree, "tree")
    levels = [_held(tree.filter("depth = 0"), 1, bool(by))]
    for d, key in enumerate(keys):
        children = tree.filter(F.col("depth") == d + 1)
        if d:
            children = _met(children, levels[d], [*by, *keys[:d]], "left_semi")
        above = [*by, *keys[: denominators[d]]]
        total = levels[denominators[d]].select(*above, F.col("link_count").alias("__total"))
        children = _met(children, total, above, "inner") if above else children.join(F.broadcast(total))
        baseline = F.lit(1.0)
        if baselines and d in baselines:
            base = baselines[d].select(F.col("key").alias("__key"), F.col("baseline").alias("__baseline"))
            children = children.join(base, F.col(key) == F.col("__key"), "left")
            baseline = F.coalesce("__baseline", F.lit(1.0))
        children = children.withColumn("__spec", F.col("link_count") / F.col("__total") / baseline)
        kept = _best(children, [*by, *keys[:d]], key, siblings).select(*tree.columns)
        levels.append(_held(kept, (2 * siblings) ** (d + 1), bool(by)))
    return reduce(DataFrame.unionByName, levels)


def _best(children: DataFrame, parent: list[str], key: str, siblings: int) -> DataFrame:
    """The children to keep of each parent. A part passes on its best by either order and, with its first, how many it had."""
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("__part")
    first = _places(children.select("*", part), [*parent, "__part"], key)
    first = first.withColumn("__n", F.when(F.col("__w") == 1, F.count("*").over(Window.partitionBy(*parent, "__part"))).otherwise(0))
    first = first.filter(F.least("__w", "__s") <= siblings).drop("__w", "__s")
    parent = parent or [F.lit(0)]
    every = _places(first, parent, key).withColumn("__n", F.sum("__n").over(Window.partitionBy(*parent)))
    return every.filter((F.col("__n") <= siblings) | (F.col(key).isNotNull() & (F.least("__w", "__s") <= siblings)))


def _places(rows: DataFrame, group: list, key: str) -> DataFrame:
    """``__w`` and ``__s``: places by links and by specialisation; the unknown child is last."""
    window, last = Window.partitionBy(*group), F.col(key).isNull()
    return rows.withColumns({
        "__w": F.row_number().over(window.orderBy(last, F.desc("link_count"), F.desc(key))),
        "__s": F.row_number().over(window.orderBy(last, F.desc("__spec"), F.desc(key))),
    })


def _met(rows: DataFrame, nodes: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on paths, in which null is a value."""
    nodes = nodes.select(*[F.col(k).alias("__" + k) for k in on], *[c for c in nodes.columns if c.startswith("__")])
    same: Column = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col("__" + k)), on[1:], F.col(on[0]).eqNullSafe(F.col("__" + on[0])))
    return rows.join(nodes, same, how)


def _held(nodes: DataFrame, most: int, many: bool) -> DataFrame:
    if many or most > HELD_NODES:
        return written(nodes, "kept")
    return nodes.sparkSession.createDataFrame(nodes.toArrow(), nodes.schema)


def cut(tree: DataFrame, depth: int) -> DataFrame:
    """Levels up to ``depth`` + 1."""
    return tree.filter(F.col("depth") <= depth + 1)


def baseline_share(rows: DataFrame, total: int, n: int, rate: float = 0.45) -> DataFrame:
    """(key, baseline) from (key, citations): the share of all citations, pulled towards the even share by ``rate``."""
    share = (F.col("citations") * F.lit(1 - rate) + F.lit(total / n * rate)) / F.lit(float(total))
    return rows.select("key", share.alias("baseline"))
