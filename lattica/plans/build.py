"""The batch build: from raw record tables to filtered, linked and counted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import filters, links, stats
from .trees import Graph


def filter_tables(t: dict[str, DataFrame], config: Config) -> dict[str, DataFrame]:
    """Kept id frames: works, sources, institutions, authors. Each step counts only over what the steps before kept."""
    works = filters.keep_works(t["works"], config).select("id")
    references = t["work_references"].select(F.col("ref").alias("src"), F.col("work").alias("dst"))
    cited = filters.degree_filter(references, least=config.min_citations, sources=works, targets=works)
    listed = t["work_sources"].select(F.col("source").alias("src"), F.col("work").alias("dst"))
    sources = filters.degree_filter(listed, least=config.min_papers_source, targets=cited)
    in_sources = filters.linked_targets(filters.within(listed, cited, "dst"), sources)
    affiliated = t["authorships"].join(t["authorship_institutions"], t["authorships"].id == t["authorship_institutions"].authorship).select(F.col("institution").alias("src"), F.col("work").alias("dst"))
    institutions = filters.degree_filter(affiliated, least=config.min_papers_institution, targets=in_sources)
    teams = t["authorships"].filter("author is not null").select(F.col("work").alias("src"), F.col("author").alias("dst"))
    small = filters.degree_filter(teams, most=config.max_authors, sources=in_sources)
    members = filters.linked_targets(teams, small)
    authors = filters.keep_authors(t["authors"], members.withColumnRenamed("dst", "id"), config)
    return {
        "works": small.withColumnRenamed("src", "id"), "sources": sources.withColumnRenamed("src", "id"),
        "institutions": filters.drop_listed(institutions.withColumnRenamed("src", "id"), config.dropped_institutions), "authors": authors,
    }


def build_graph(t: dict[str, DataFrame], kept: dict[str, DataFrame], config: Config) -> Graph:
    """Links between kept entities as the attribute tables of breakdown trees; external ids stay the keys."""
    works = kept["works"]
    years = filters.within(t["works"], works, "id").select(F.col("id").alias("ref"), F.col("publication_year").alias("year"))
    citing = filters.within(filters.within(t["work_references"], works, "work"), works, "ref").select("ref", F.col("work").alias("cit")).distinct()
    topics = filters.within(t["work_topics"].filter(F.col("score") > config.min_topic_score), works, "work").select("work", "topic")
    subfield_topic = topics.join(t["topics"].select(F.col("id").alias("topic"), "subfield"), "topic").select("work", "subfield", "topic")
    sources = filters.within(filters.within(t["work_sources"], works, "work"), kept["sources"], "source")
    work_years = years.select(F.col("ref").alias("work"), "year")
    quartiles = t["source_quartiles"].select(F.col("id").alias("source"), F.col("publication_year").alias("year"), F.col("best_q").alias("q"))
    source = links.best_source(sources, work_years, quartiles)
    source = works.select(F.col("id").alias("work")).join(source, "work", "left").select("work", "source")
    quartile_source = source.join(work_years, "work").join(quartiles, ["source", "year"], "left").select("work", F.coalesce("q", F.lit(0)).alias("quartile"), "source")
    ships = filters.within(t["authorships"], works, "work").join(kept["authors"].select(F.col("id").alias("known")), F.col("author") == F.col("known"), "left").select(F.col("id").alias("authorship"), "work", F.col("known").alias("author"))
    affiliated = ships.join(filters.within(t["authorship_institutions"], kept["institutions"], "institution"), "authorship").select("authorship", "work", "author", F.col("institution").alias("inst"))
    countries = filters.within(t["institutions"], kept["institutions"], "id").select(F.col("id").alias("inst"), F.col("country_code").alias("country"))
    inst = affiliated.select("work", "inst").distinct()
    country_inst = inst.join(countries, "inst", "left").select("work", "country", "inst")
    both = {
        "topic": topics.distinct(), "subfield_topic": subfield_topic.distinct(), "subfield": subfield_topic.select("work", "subfield").distinct(),
        "source": source, "quartile_source": quartile_source, "inst": inst, "country_inst": country_inst, "country": country_inst.select("work", "country").distinct(),
        "author": ships.select("work", "author").distinct(), "author_inst": affiliated.select("work", "author", "inst").distinct(),
    }
    tables = {(side, name): frame for side in "rc" for name, frame in both.items()}
    tables["r", "inst_country"] = countries
    entity = lambda name, col: both[name].filter(F.col(col).isNotNull()).select(F.col(col).alias("entity"), "work").distinct()
    roots = {"authors": entity("author", "author"), "institutions": entity("inst", "inst"), "countries": entity("country", "country"), "sources": sources.select(F.col("source").alias("entity"), "work").distinct(), "subfields": entity("subfield", "subfield"), "topics": entity("topic", "topic")}
    return Graph(citing, years, tables, roots, config.year_filters)


def write_tables(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Each table as Parquet under ``path``, and read again: later steps plan from files, not from the records."""
    out = {}
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/{name}")
    return out


def write_graph(graph: Graph, path: str) -> None:
    """The graph's tables as Parquet: citing, years, attributes/<side>_<name>, roots/<kind>."""
    tables = {"citing": graph.citing, "years": graph.years}
    tables |= {f"attributes/{side}_{name}": frame for (side, name), frame in graph.tables.items()}
    tables |= {f"roots/{kind}": frame for kind, frame in graph.roots.items()}
    write_tables(tables, path)


def read_graph(spark: SparkSession, path: str, like: Graph) -> Graph:
    """A written graph; ``like`` says which attributes and roots it has."""
    read = lambda name, frame: spark.read.schema(frame.schema).parquet(f"{path}/{name}")
    tables = {(side, name): read(f"attributes/{side}_{name}", frame) for (side, name), frame in like.tables.items()}
    roots = {kind: read(f"roots/{kind}", frame) for kind, frame in like.roots.items()}
    return Graph(read("citing", like.citing), read("years", like.years), tables, roots, like.year_filters, like.baselines, like.labels)


def entity_statistics(graph: Graph, config: Config) -> dict[str, DataFrame]:
    """(entity, papers, citations, yearly arrays) for every kind of root."""
    citing = graph.citing.select(F.col("ref").alias("work"), F.col("cit").alias("citing"))
    citations = stats.citing_counts(citing)
    years = graph.years.select(F.col("ref").alias("work"), "year")
    out = {}
    for kind, works in graph.roots.items():
        papers = stats.work_counts(works)
        cites = stats.cite_counts(works, citations)
        per_year = stats.yearly(works.join(years, "work"), config.final_year, config.era_years).withColumnRenamed("series", "papers_yearly")
        cited = works.join(citing, "work").join(years.select(F.col("work").alias("citing"), "year"), "citing")
        cited_per_year = stats.yearly(cited, config.final_year, config.era_years).withColumnRenamed("series", "citations_yearly")
        out[kind] = papers.join(cites, "entity", "left").join(per_year, "entity", "left").join(cited_per_year, "entity", "left").fillna(0, ["citations"])
    return out


def entity_relations(graph: Graph, config: Config) -> dict[str, DataFrame]:
    """(entity, inst, papers, citations, first_year, last_year, rank) for every kind of root; countries and authors have their own institutions only."""
    inst, affiliations = graph.tables["r", "inst"], graph.tables["r", "author_inst"]
    cited = stats.citing_counts(graph.citing.select(F.col("ref").alias("work")))
    years = graph.years.select(F.col("ref").alias("work"), "year")
    out = {}
    for kind, works in graph.roots.items():
        if kind == "countries":
            rows = stats.country_institutions(works, inst, graph.tables["r", "inst_country"])
        elif kind == "authors":
            rows = stats.author_institutions(works, affiliations)
        else:
            rows = works.join(inst, "work").select("entity", "work", "inst")
        rows = rows.join(years, "work").join(cited, "work", "left").fillna(0, ["citations"])
        out[kind] = stats.institution_relations(rows, config.top_relations)
    return out
