"""Dense ids and the algebra of typed links, as long edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import numbered


def dense_ids(rows: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """(key, id): ids 1..n over the distinct non-null keys, in key order; no task sees all keys."""
    return numbered(rows.select(key).filter(F.col(key).isNotNull()).distinct(), [F.col(key)], "id", 1, blocks)


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first in ``order``."""
    others = [c for c in rows.columns if c != key]
    first = F.min(F.struct(F.col(order), *[c for c in others if c != order]))
    return rows.groupBy(key).agg(first.alias("__first")).select(key, *[F.col(f"__first.{c}").alias(c) for c in others])


def map_link(edges: DataFrame, src_ids: DataFrame, dst_ids: DataFrame, many: bool = False, order: str | None = None) -> DataFrame:
    """External ends to dense ids: (src, dst). Unknown sources go; unknown targets are null for single links and go for many.

    A single link keeps a source's last row by ``order``, of equal ones that of the largest target.
    """
    if not many:
        last = F.max(F.struct(*([order] if order else []), "dst")).alias("last")
        edges = edges.groupBy("src").agg(last).select("src", F.col("last.dst").alias("dst"))
    mapped = edges.join(src_ids.select(F.col("key").alias("src"), F.col("id").alias("src_id")), "src")
    mapped = mapped.join(dst_ids.select(F.col("key").alias("dst"), F.col("id").alias("dst_id")), "dst", "inner" if many else "left")
    return mapped.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def invert(edges: DataFrame) -> DataFrame:
    """(src, dst) for (dst, src); unknown ends go, duplicates stay."""
    return edges.filter("src is not null and dst is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def as_lists(edges: DataFrame) -> DataFrame:
    """(src, dsts): ascending array of targets."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))


def collapse(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct (src, dst) over src -> mid -> dst. An unknown last step of a single link stays as null."""
    left, right = first.select("src", F.col("dst").alias("mid")), second.select(F.col("src").alias("mid"), "dst")
    return left.join(right, "mid").select("src", "dst").distinct()


def group_invert(edges: DataFrame) -> DataFrame:
    """(src, dsts) of the inverse of a single link."""
    return as_lists(invert(edges))


def authorship_links(authorships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(authorship, author), (authorship, institution) and (work, authorship) from rows of id, work, author, institutions."""
    from ..functions.columns import split_list

    author = authorships.select(F.col("id").alias("src"), F.col("author").alias("dst"))
    institutions = authorships.select(F.col("id").alias("src"), F.explode(split_list(F.col("institutions"))).alias("dst"))
    return author, institutions, authorships.select(F.col("work").alias("src"), F.col("id").alias("dst"))


def source_quartiles(quartiles: DataFrame, source_ids: DataFrame) -> DataFrame:
    """(source, year, q) of known sources, one row per source and year (the best)."""
    return quartiles.join(source_ids, quartiles.id == source_ids.key).groupBy(source_ids.id.alias("source"), F.col("publication_year").alias("year")).agg(F.min("best_q").alias("q"))


def issn_pairs(sources: DataFrame) -> DataFrame:
    """Distinct (id, issn) from the list and the linking number."""
    listed = sources.select("id", F.explode("issn").alias("issn"))
    return listed.unionByName(sources.select("id", F.col("issn_l").alias("issn"))).filter("issn is not null").distinct()


def issn_join(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts by ISSN, given to the sources that have it; distinct. A fact that is listed many times meets its sources once."""
    return pairs.join(facts.distinct(), "issn").drop("issn").distinct()


def best_source(work_sources: DataFrame, work_years: DataFrame, quartiles: DataFrame) -> DataFrame:
    """(work, source): the source of the best quartile in the work's year; 0 and none count as 5, ties go to the first listed.

    work_sources has work, source, position.
    """
    known = work_sources.join(work_years, "work", "left").join(quartiles, ["source", "year"], "left")
    rank = F.coalesce(F.nullif(F.col("q"), F.lit(0)), F.lit(5))
    best = F.min(F.struct(rank.alias("q"), F.col("position"), F.col("source")))
    return known.groupBy("work").agg(best.alias("best")).select("work", F.col("best.source").alias("source"))
