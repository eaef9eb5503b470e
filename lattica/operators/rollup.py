"""Hierarchical rollups with exact distinct counts, and their handling of periods.

Input tuples are (keys..., ref, cit). For every prefix of the keys the result has the number of distinct refs,
of distinct (ref, cit) pairs, and the ref with most distinct cits (ties: the lowest ref). Two aggregations do it:
the first counts cits per prefix and ref, the second sums and ranks refs per prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tuples that one task of a rollup is meant to hold.
TASK_ROWS = 100_000


@dataclass(frozen=True)
class Extent:
    """How large a rollup is: ``parts`` that its tuples are dealt into, and the bits of the highest ref, if that and any count of cits fit a long together."""

    parts: int | None = None
    ref_bits: int | None = None


def extent(links: DataFrame) -> Extent:
    """Of the links (ref, ...) that a rollup's tuples come from. Parts grow in number with them, so that a task's share stays the same; there are no fewer than cores."""
    rows, known, low, high = links.agg(F.count("*"), F.count("ref"), F.min("ref"), F.max("ref")).first()
    fits = isinstance(high, int) and known == rows and low >= 0 and high.bit_length() + rows.bit_length() < 63
    return Extent(max(links.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), high.bit_length() if fits else None)


def dealt(rows: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """The rows by hash in so many parts, or as many as the session shuffles to."""
    return rows.repartition(parts, *by) if parts else rows.repartition(*by)


def new_prefixes(rows: DataFrame, within: list[str], keys: list[str]) -> DataFrame:
    """The rows that add a prefix of the keys to those of the rows before them of the same ``within``, with the length of the first one added, ``__new``."""
    before = F.lag(F.struct(F.lit(True).alias("any"), *[F.col(k).alias(f"v{d}") for d, k in enumerate(keys)])).over(Window.partitionBy(*within).orderBy(*(keys or within[-1:])))
    new = F.when(F.col("__before").isNull(), F.lit(0))
    for d, k in enumerate(keys):
        new = new.when(~F.col("__before")[f"v{d}"].eqNullSafe(F.col(k)), F.lit(d + 1))
    return rows.withColumn("__before", before).withColumn("__new", new).drop("__before").filter("__new is not null")


def per_ref(tuples: DataFrame, keys: list[str], extra: list[str], parts: int | None = None) -> DataFrame:
    """One row per prefix and ref: depth, keys, ref, n distinct cits.

    Tuples are shuffled once, by ref, and sorted. A tuple is new under every prefix beyond the one it shares with the tuple before it of its ref
    and cit, so no pairs are kept to tell which were seen.
    """
    rows = dealt(tuples.select(*keys, *extra, "ref", "cit"), parts, "ref")
    rows = new_prefixes(rows, [*extra, "ref", "cit"], keys).select(*keys, *extra, "ref", "cit", "__new")
    levels = rows.withColumn("depth", F.explode(F.sequence(F.col("__new"), F.lit(len(keys)))))
    prefix = [F.when(F.col("depth") > d, F.col(k)).alias(k) for d, k in enumerate(keys)]
    return levels.select("depth", *prefix, *extra, "ref", "cit").groupBy("depth", *keys, *extra, "ref").agg(F.count("cit").alias("n"))


def per_prefix(per_ref: DataFrame, by: list[str], ref_bits: int | None = None) -> DataFrame:
    """One row per prefix (and what else is in ``by``) of rows of ``per_ref``; sums and maxima, so a prefix of many refs is combined before it is shuffled.

    With ``ref_bits`` the count and the ref are one number, whose maximum a hash table can keep; a maximum of structs sorts all rows.
    """
    if ref_bits is None:
        low, top = (-F.col("top.low")).cast("long"), F.col("top.n").cast("long")
        best = F.max(F.struct(F.col("n"), (-F.col("ref")).alias("low")))
    else:
        most = F.lit((1 << ref_bits) - 1).cast("long")
        low, top = most - F.col("top").bitwiseAND(most), F.shiftright("top", ref_bits)
        best = F.max(F.shiftleft("n", ref_bits) + most - F.col("ref").cast("long"))
    out = per_ref.groupBy("depth", *by).agg(F.sum("n").cast("long").alias("link_count"), F.count("*").cast("long").alias("source_count"), best.alias("top"))
    return out.select("depth", *by, "link_count", "source_count", low.alias("top_source"), top.alias("top_source_links"))


def rollup(tuples: DataFrame, keys: list[str], size: Extent = Extent()) -> DataFrame:
    """(depth, keys..., link_count, source_count, top_source, top_source_links); depth 0 is the root, unused keys are null."""
    return per_prefix(per_ref(tuples, keys, [], size.parts), keys, size.ref_bits)


def since_year(tuples: DataFrame, year: int, col: str = "year") -> DataFrame:
    """Tuples whose ref is of that year or later."""
    return tuples.filter(F.col(col) >= year)


def rollup_periods(tuples: DataFrame, keys: list[str], periods: int, size: Extent = Extent()) -> DataFrame:
    """The rollup for every period filter at once: column ``period`` p covers refs of period p and later.

    Tuples have the ref's ``period``. A ref has one period, so each period is rolled up by itself and the few
    results per prefix are then added up from the latest back.
    """
    single = per_prefix(per_ref(tuples, keys, ["period"], size.parts), [*keys, "period"], size.ref_bits)
    return in_periods(single, keys, periods)


def in_periods(single: DataFrame, keys: list[str], periods: int) -> DataFrame:
    """Nodes of single periods, added up from the latest back."""
    return fold_disjoint(single.withColumn("period", F.explode(F.sequence(F.lit(0), F.col("period")))).filter(F.col("period") < periods), [*keys, "period"])


def fold_disjoint(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Add up nodes over disjoint sets of refs: counts are summed, the top source is the larger, ties the lowest."""
    top = F.max(F.struct(F.col("top_source_links").alias("n"), (-F.col("top_source")).alias("low"))).alias("top")
    out = nodes.groupBy("depth", *by).agg(F.sum("link_count").cast("long").alias("link_count"), F.sum("source_count").cast("long").alias("source_count"), top)
    return out.select("depth", *by, "link_count", "source_count", (-F.col("top.low")).cast("long").alias("top_source"), F.col("top.n").cast("long").alias("top_source_links"))


def union_trees(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two rollups over disjoint refs."""
    return fold_disjoint(first.unionByName(second), keys)


def sum_of_children(nodes: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Parents at ``depth`` as the sum of their children, for levels under which refs are disjoint."""
    children = nodes.filter(F.col("depth") == depth + 1).withColumn("depth", F.lit(depth))
    for k in keys[depth:]:
        children = children.withColumn(k, F.lit(None).cast(nodes.schema[k].dataType))
    return fold_disjoint(children, keys)
