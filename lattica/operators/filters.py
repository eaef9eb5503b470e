"""Row predicates and degree-bounded edge filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config


def keep_works(works: DataFrame, config: Config) -> DataFrame:
    """Works that are not retracted, of a kept kind and dated within (start, final]; an unknown year is outside."""
    year = F.coalesce(F.col("publication_year"), F.lit(0))
    return works.filter(~F.coalesce("is_retracted", F.lit(False)) & F.col("type").isin(*config.work_kinds) & (year > config.start_year) & (year <= config.final_year))


def keep_ids(rows: DataFrame, condition: Column, id_col: str = "id") -> DataFrame:
    return rows.filter(condition).select(id_col).distinct()


def within(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` is among the ids (a one-column frame)."""
    name = ids.columns[0]
    return rows.join(ids.withColumnRenamed(name, "__id"), F.col(col) == F.col("__id"), "left_semi")


def without(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    name = ids.columns[0]
    return rows.join(ids.withColumnRenamed(name, "__id"), F.col(col) == F.col("__id"), "left_anti")


def degree_filter(edges: DataFrame, least: int | None = None, most: int | None = None, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Ids ``src`` with a bounded number of distinct ``dst``, counted over edges whose ends pass the given id frames."""
    if sources is not None:
        edges = within(edges, sources, "src")
    if targets is not None:
        edges = within(edges, targets, "dst")
    degree = edges.filter("src is not null and dst is not null").groupBy("src").agg(F.count_distinct("dst").alias("degree"))
    if least is not None:
        degree = degree.filter(F.col("degree") >= least)
    if most is not None:
        degree = degree.filter(F.col("degree") <= most)
    return degree.select("src")


def linked_targets(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Ids ``dst`` that some kept source links to."""
    return within(edges, sources, "src").select("dst").distinct()


def keep_authors(authors: DataFrame, candidates: DataFrame, config: Config) -> DataFrame:
    """Fixed authors, and candidates with enough works and citations."""
    enough = (F.col("works_count") >= config.min_author_works) & (F.col("cited_by_count") >= config.min_author_citations)
    passed = within(authors.filter(enough), candidates, "id").select("id")
    fixed = authors.filter(F.col("id").isin(*config.fixed_authors)).select("id") if config.fixed_authors else authors.limit(0).select("id")
    return passed.unionByName(fixed).distinct()


def drop_listed(rows: DataFrame, listed, col: str = "id") -> DataFrame:
    return rows.filter(~F.col(col).isin(*listed)) if listed else rows


def hits(counts: DataFrame, least: int, col: str = "citations") -> DataFrame:
    return counts.filter(F.col(col) >= least)


def era(rows: DataFrame, last_year: int, years: int, col: str = "year") -> DataFrame:
    """The last ``years`` years up to ``last_year``."""
    return rows.filter(F.col(col).between(last_year - years + 1, last_year))


def searchable(entities: DataFrame, least_papers: int = 2, least_citations: int = 3, most_papers: int | None = None, worst_quartile: int | None = None) -> DataFrame:
    """Named entities with a slug, enough papers and citations, and within the bounds that some kinds have."""
    ok = (F.col("name") != "") & (F.col("slug") != "") & (F.col("papers") >= least_papers) & (F.col("citations") >= least_citations)
    if most_papers is not None:
        ok &= F.col("papers") < most_papers
    if worst_quartile is not None:
        ok &= F.col("best_q") <= worst_quartile
    return entities.filter(ok)


def highlighted(entities: DataFrame, ids=(), most_citations: int = 8_000_000) -> DataFrame:
    """Entities on an allow-list or with citations beyond a bound."""
    return entities.filter(F.col("id").isin(*ids) | (F.col("citations") > most_citations)) if ids else entities.filter(F.col("citations") > most_citations)
