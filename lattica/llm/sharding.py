"""Sharding by best-fit-decreasing: indivisible groups go, largest first, to the bin with the least room that still fits.

Open bins stand in a balanced tree (a treap) keyed by remaining capacity. Groups that matter alone (over a
fixed share of a shard) are packed one by one; all smaller groups are first dealt by hash into a fixed number of
units, so what is packed on the driver is bounded by the parameters and not by the corpus.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch


class CapacityTree:
    """A treap of (room, bin); find_fit gives the entry with the least room of at least ``size``."""

    def __init__(self, seed: int = 7):
        self.root, self.rng = None, random.Random(seed)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] < high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def add(self, room: int, number: int) -> None:
        low, high = self._split(self.root, (room, number))
        self.root = self._merge(self._merge(low, [(room, number), self.rng.random(), None, None]), high)

    def remove(self, room: int, number: int) -> None:
        low, rest = self._split(self.root, (room, number))
        _, high = self._split(rest, (room, number + 1))
        self.root = self._merge(low, high)

    def find_fit(self, size: int):
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each size. Sizes over the capacity get a bin of their own; ties go in the order given."""
    tree, bins, out = CapacityTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.find_fit(sizes[i])
        if found is None:
            room, out[i], bins = capacity, bins, bins + 1
        else:
            (room, out[i]), _ = found, tree.remove(*found)
        if room > sizes[i]:
            tree.add(room - sizes[i], out[i])
    return out


def pack_into(sizes: list[int], bins: int) -> list[int]:
    """Best-fit-decreasing under the least capacity (to one part in 10,000) that needs no more than ``bins`` bins."""
    if not sizes:
        return []
    low = max(-(-sum(sizes) // bins), max(sizes))
    high = 2 * low
    while max(best_fit_decreasing(sizes, high)) >= bins:
        high *= 2
    out = best_fit_decreasing(sizes, low)
    if max(out) < bins:
        return out
    out = best_fit_decreasing(sizes, high)
    while high - low > max(1, low // 10_000):
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes, middle)
        low, high, out = (low, middle, tried) if max(tried) < bins else (middle, high, out)
    return out


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", units: int = 4096, heavy_share: int = 1024) -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row in one of ``n_shards`` shards of near-equal bytes.

    Size is the UTF-8 length of the text plus one (null text: 1). Rows of equal text are one group and share a
    shard, whatever their number; null texts are a group apart from empty ones. Slots count from 0 without gaps in each
    shard. Repeated ids keep their rows; null ids are rows like others. An empty table gives no rows.

    At most n_shards * heavy_share groups exceed 1/heavy_share of a shard, and ``units`` units hold the rest: that
    is all the driver packs and broadcasts.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.put(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(F.col(text_col), 256)), F.lit(b"")).alias("key"),
    ), "rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    limit = max(1, total // (n_shards * heavy_share))
    unit = F.pmod(F.xxhash64("key"), F.lit(units)).cast("int")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("heavy", F.col("bytes") > limit)
    owner = F.when(F.col("heavy"), F.col("key"))
    sums = groups.groupBy(owner.alias("key"), F.when(~F.col("heavy"), unit).alias("unit")).agg(F.sum("bytes").alias("bytes")).orderBy("unit", "key").collect()
    where = pack_into([r.bytes for r in sums], n_shards)
    spark = docs.sparkSession
    small = {r.unit: s for r, s in zip(sums, where) if r.key is None}
    heavy = spark.createDataFrame([(bytes(r.key), s) for r, s in zip(sums, where) if r.key is not None], "key binary, own int")
    by_unit = F.array(*[F.lit(small.get(u, 0)) for u in range(units)]) if units <= 64 else None
    placed = rows.join(F.broadcast(heavy), "key", "left")
    if by_unit is None:
        table = spark.createDataFrame([(u, s) for u, s in small.items()], "unit int, light int")
        placed = placed.withColumn("unit", unit).join(F.broadcast(table), "unit", "left")
        placed = placed.withColumn("shard", F.coalesce("own", "light"))
    else:
        placed = placed.withColumn("shard", F.coalesce("own", F.get(by_unit, unit)))
    return with_slots(placed.select("id", "size", "text_crc32", "shard", "key"), n, n_shards).select("id", "size", "text_crc32", "shard", "slot")


def with_slots(placed: DataFrame, n: int, n_shards: int, block_rows: int = 50_000) -> DataFrame:
    """Gapless numbers within each shard: counts of small hashed blocks give offsets, rows are numbered inside blocks."""
    blocks = max(32, -(-n // (n_shards * block_rows)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "block").orderBy("id", "key")
    numbered = placed.withColumn("nth", F.row_number().over(inside))
    return numbered.join(offsets, ["shard", "block"]).withColumn("slot", F.col("offset") + F.col("nth") - 1)
