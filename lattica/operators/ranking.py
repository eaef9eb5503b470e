"""Ranks, slices, samples and set operations on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 0, blocks: int | None = None) -> DataFrame:
    """The rows with their place in ``order`` as a long column ``name``, from ``start`` on.

    One range exchange; each partition is sorted and counts its own rows as it is written. The written table fixes which row lies in
    which partition, so the offsets, a sum over the sizes of ``blocks`` partitions (the session's number of shuffle partitions), belong to
    the very same rows. Rows that are equal in all of ``order`` get places next to each other, in no set order. A column of the name is
    replaced; an empty table stays empty.
    """
    blocks = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, nth = free_names(rows, "part", "nth")
    placed = rows.drop(name).repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn(nth, F.monotonically_increasing_id())
    placed = written(placed.withColumn(part, F.shiftright(nth, 33)).withColumn(nth, F.col(nth).bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    offsets = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    (offset,) = free_names(rows, "offset")
    out = placed.join(F.broadcast(offsets.withColumnRenamed("offset", offset)), part)
    return out.withColumn(name, (F.col(nth) + F.col(offset) + F.lit(start)).cast("long")).drop(part, nth, offset)


def free_names(rows: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as long as the rows have such a column (in any case of letters)."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def ranked(rows: DataFrame, by: str = "citations", id_col: str = "id", blocks: int | None = None) -> DataFrame:
    """Adds ``rank`` from 0: most first (nulls last), then the lower id. The rows are written once in rank order."""
    return numbered(rows, [F.desc(by), F.col(id_col)], "rank", 0, blocks)


def page(rows: DataFrame, start: int, end: int, n: int | None = None, most: int = 1000) -> DataFrame:
    """Rows of a rank within [start, end), at least one and at most ``most``; bounds beyond the table are pulled in."""
    n = rows.count() if n is None else n
    start = max(0, min(start, n - 1))
    end = min(max(start + 1, min(start + most, end)), n)
    return rows.filter((F.col("rank") >= start) & (F.col("rank") < end))


def smallest_distinct(rows: DataFrame, col: str, n: int = 16) -> DataFrame:
    """The n smallest distinct values, ascending."""
    return rows.select(col).distinct().orderBy(col).limit(n)


def sample(rows: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows in an order fixed by the seed and the ids."""
    return rows.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)


def union_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.union(second).distinct()


def append_missing(first: DataFrame, second: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, source): the ids of the first (0), then those only in the second (1)."""
    both = first.select(id_col, F.lit(0).alias("source")).union(second.select(id_col, F.lit(1).alias("source")))
    return both.groupBy(id_col).agg(F.min("source").alias("source"))


def intersect_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.intersect(second)


def difference_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.subtract(second)


def merge_sides(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(key, side): "left", "right" or "both"."""
    l, r = left.select(key, F.lit(1).alias("__l")).distinct(), right.select(key, F.lit(1).alias("__r")).distinct()
    side = F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both")
    return l.join(r, key, "full").select(key, side.alias("side"))


def entity_counts(**entities: DataFrame) -> DataFrame:
    """(entity, n) of each named frame."""
    out = None
    for name, rows in entities.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out
