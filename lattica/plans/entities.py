"""What a server shows of each entity: its table with name, slug and rank, top lists, names and baselines of tree nodes."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import columns as C
from ..operators import filters, links, lists, prune, ranking, slugs, stats
from ..scratch import written
from . import build
from .trees import Graph

#: Kind of root -> kind of tree level.
LEVEL_OF = {"authors": "author", "institutions": "inst", "countries": "country", "sources": "source", "subfields": "subfield", "topics": "topic"}
#: Number of a top list -> kind of entity that it lists and how many at most.
PRIME_LISTS = (("subfields", 3), ("subfields", 3), ("topics", 3), ("countries", 3), ("sources", 3), ("authors", 5))
#: Works of an entity whose authors one task ranks.
ENTITY_WORKS = 10_000
#: h-indices up to this are told by sums.
LOW_H = 12
#: Kinds that have pages, and what an entity needs to have one.
SHOWN = {
    "authors": {"most_papers": 1000}, "institutions": {}, "countries": {}, "subfields": {},
    "sources": {"least_papers": 11, "least_citations": 21, "worst_quartile": 2},
}


def entity_names(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """(id, name, extension, candidates) of every kind: the name shown, what search also finds, and slugs to try in order."""
    none = F.lit("")
    inst = t["institutions"].dropDuplicates(["id"])
    shown = slugs.distinct_names(inst.select("id", "name", "country", "city")).select("id", F.col("name").alias("shown"))
    inst = inst.join(shown, "id").select("id", F.col("shown").alias("name"), F.coalesce("name_extension", none).alias("extension"), slugs.institution_candidates(F.col("name"), F.col("display_name_acronyms"), F.col("display_name_alternatives"), F.col("country")).alias("candidates"))
    countries = t["institutions"].filter("country_code is not null").groupBy(F.col("country_code").alias("id")).agg(F.coalesce(F.max("country"), F.max("country_code")).alias("name"))
    sources = t["sources"].dropDuplicates(["id"]).withColumn("name", C.journal_name(F.col("name")))
    sources = sources.select("id", "name", F.coalesce("name_extension", none).alias("extension"), slugs.source_candidates(F.col("name"), F.col("alternate_titles"), F.col("abbreviated_title")).alias("candidates"))

    def plain(rows: DataFrame) -> DataFrame:
        return rows.dropDuplicates(["id"]).select("id", "name", none.alias("extension"), F.array(C.slug(F.col("name"))).alias("candidates"))

    return {"authors": plain(t["authors"]), "institutions": inst, "countries": plain(countries), "sources": sources, "subfields": plain(t["subfields"]), "topics": plain(t["topics"])}


def source_values(graph: Graph, t: dict[str, DataFrame]) -> DataFrame:
    """(source, h, upper_median, best_q, value) of every source, by the works whose best source it is."""
    cited = stats.citing_counts(graph.citing.select(F.col("ref").alias("work")))
    years = graph.years.select(F.col("ref").alias("work"), "year")
    quartiles = t["source_quartiles"].select(F.col("id").alias("source"), F.col("publication_year").alias("year"), F.col("best_q").alias("q"))
    return stats.source_stats(graph.tables["r", "source"].filter("source is not null"), cited, years, quartiles)


def prime_lists(graph: Graph, kind: str, values: DataFrame) -> DataFrame:
    """(entity, rel_type, related, score, rank): the six top lists of every entity of a kind.

    0 subfields of its works, 1 subfields that cite them, 2 topics, 3 countries, by number; 4 sources by their value (``values``: source, value),
    the number as score; 5 authors by the h-index of their works within the entity. Ties go to the lower id. The unknown, and of its
    own kind the entity itself, are left out. Ids are strings here, as some kinds have codes.

    A work is dealt to each of its entities as one row with arrays of what it has, and counted there.
    """
    large = graph.roots[kind].groupBy("entity").agg(F.ceil(F.count("*") / ENTITY_WORKS).alias("blocks")).filter("blocks > 1")
    homes = graph.roots[kind].groupBy("work").agg(F.collect_list("entity").alias("entities"))
    return _most_related(graph, kind, values, homes, large).unionByName(_best_authors(graph, kind, homes, large))


def _by_number() -> list[Column]:
    """The order of ids as strings."""
    return [F.expr("try_cast(related as bigint)"), F.col("related")]


def _most_related(graph: Graph, kind: str, values: DataFrame, homes: DataFrame, large: DataFrame) -> DataFrame:
    """``prime_lists`` but for the authors. Subfields, topics, countries and sources are numbered, and a work's numbers are counted once for all its entities.

    Of an entity of few works all rows lie in one task; of ``large`` ones counts are added up before they are shuffled.
    """
    r, parts = graph.tables, graph.size().parts
    tables = [(k, r["c" if k == 1 else "r", col].select("work", F.col(col).alias("related")).filter("related is not null")) for k, col in enumerate(("subfield", "subfield", "topic", "country", "source"))]
    known = reduce(DataFrame.unionByName, [rows.select(F.lit(k).alias("rel_type"), F.col("related").cast("string").alias("related")).distinct() for k, rows in tables])
    # of equal ones the lower number comes first
    known = written(ranking.numbered(known, [F.col("rel_type"), *_by_number()], "id"), "related")
    number = F.col("id").cast(lists.narrowest(known.count()))
    own = None
    for k, rows in tables:
        ids = known.filter(F.col("rel_type") == k).select("id", F.col("related").alias("__related"))
        rows = rows.join(ids, F.col("related").cast("string") == F.col("__related")).select(F.col("work").alias("ref"), number.alias("own"))
        rows = graph.citing.join(rows.withColumnRenamed("ref", "cit"), "cit").select("ref", "own") if k == 1 else rows
        own = rows if own is None else own.unionByName(rows)
    counts = lists.count_lists(own, parts).withColumnRenamed("ref", "work").join(homes, "work")
    counts = counts.select(F.explode("entities").alias("entity"), "of", "near", "far", "small", "large")
    worth = values.select(F.lit(4).alias("rel_type"), F.col("source").cast("string").alias("related"), F.col("value").cast("long").alias("value"))
    known = known.join(worth, ["rel_type", "related"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    most = F.element_at(F.array(*[F.lit(n) for _, n in PRIME_LISTS]), F.col("rel_type") + 1)
    ranks, told = known.select("id", "rel_type", "value"), known.select("id", "related")
    same = known.filter(F.col("rel_type").isin([k for k, _ in tables if PRIME_LISTS[k][0] == kind])).select("id", F.col("related").alias("itself"))

    def top(rows: DataFrame) -> DataFrame:
        rows = lists.each_count(rows)
        rows = rows.groupBy("entity", F.col("__p").alias("id")).agg(F.sum("n").alias("score"))
        if kind in [of for of, _ in PRIME_LISTS[: len(tables)]]:
            rows = rows.join(same, "id", "left").filter(~F.col("itself").eqNullSafe(F.col("entity").cast("string"))).drop("itself")
        rows = stats.top_n(rows.join(ranks, "id"), ["entity", "rel_type"], [F.desc("value"), F.desc("score"), F.col("id")], max(n for _, n in PRIME_LISTS))
        return rows.filter(F.col("rank") <= most).join(told, "id").select("entity", "rel_type", "related", "score", "rank")

    large = F.broadcast(large.select("entity"))
    return top(counts.join(large, "entity", "left_anti").repartition(parts, "entity")).unionByName(top(counts.join(large, "entity", "left_semi")))


def _best_authors(graph: Graph, kind: str, homes: DataFrame, large: DataFrame) -> DataFrame:
    """The authors of ``prime_lists``. An entity's authors lie in one task, or for each 10,000 of its works."""
    cited = stats.citing_counts(graph.citing.select(F.col("ref").alias("work")))
    people = graph.tables["r", "author"].filter("author is not null").groupBy("work").agg(F.collect_list("author").alias("related"))
    people = people.join(cited, "work", "left").select("work", F.coalesce("citations", F.lit(0)).alias("c"), "related")
    rows = people.join(homes, "work").select(F.explode("entities").alias("entity"), "c", "related").join(F.broadcast(large), "entity", "left")
    block = lambda x: F.pmod(F.xxhash64(x), F.col("blocks"))
    rows = rows.select("entity", "c", "related", "blocks", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform("related", block)))).alias("block"))
    within = F.when(F.col("blocks").isNull(), F.col("related")).otherwise(F.filter("related", lambda x: block(x) == F.col("block")))
    rows = rows.select("entity", "block", "c", within.alias("related"), F.lit(0).cast("long").alias("beyond"))

    def each(packed: DataFrame) -> DataFrame:
        pairs = packed.select("entity", "block", "c", "beyond", F.explode("related").alias("related"))
        return pairs.filter(F.col("related") != F.col("entity")) if PRIME_LISTS[5][0] == kind else pairs

    by = ["entity", "block", "related"]
    beyond = stats.h_beyond(each(rows), by, LOW_H).withColumn("related", F.array("related"))
    dealt = lists.slim(rows.unionByName(beyond), "related").repartition(graph.size().parts, "entity", "block")
    authors = stats.h_by_sums(each(dealt.withColumn("related", lists.unslim(dealt))), by, LOW_H)
    number = [F.col("related")] if isinstance(authors.schema["related"].dataType, T.IntegralType) else _by_number()
    n = PRIME_LISTS[5][1]
    authors = stats.top_n(authors, ["entity", "block"], [F.desc("h"), *number], n).drop("rank")
    return stats.top_n(authors, ["entity"], [F.desc("h"), *number], n).select("entity", F.lit(5).alias("rel_type"), F.col("related").cast("string").alias("related"), F.col("h").alias("score"), "rank")


def with_labels(graph: Graph, statistics: dict[str, DataFrame], names: dict[str, DataFrame], works: DataFrame) -> Graph:
    """The graph with names of every kind of level, works (id, name) and quartiles too, and with baselines from citations.

    A kind's baseline share is that of its citations in those of all its entities, pulled towards the even share.
    """
    labels = {level: names[kind].select(F.col("id").alias("key"), "name") for kind, level in LEVEL_OF.items()}
    labels["work"] = works.select(F.col("id").alias("key"), "name")
    quartiles = graph.tables["r", "quartile_source"].select(F.col("quartile").alias("key")).distinct()
    labels["quartile"] = quartiles.select("key", C.quartile_label(F.col("key")).alias("name"))
    baselines = {}
    for kind, level in LEVEL_OF.items():
        rows = statistics[kind].select(F.col("entity").alias("key"), "citations")
        total, n = rows.agg(F.coalesce(F.sum("citations"), F.lit(0)), F.count("*")).first()
        if total:
            baselines[level] = prune.baseline_share(rows, total, n)
    return replace(graph, labels=labels, baselines=baselines)


def entity_tables(statistics: dict[str, DataFrame], names: dict[str, DataFrame], values: DataFrame, config: Config) -> dict[str, DataFrame]:
    """Ranked entities of the kinds that have pages: id, name, extension, slug, papers, citations, the yearly arrays, first_year, rank.

    Slugs are given to all entities of a kind, in order of their papers, before those without enough papers or citations go.
    """
    first = config.final_year - config.era_years + 1
    out = {}
    for kind, needs in SHOWN.items():
        rows = statistics[kind].withColumnRenamed("entity", "id").join(names[kind], "id")
        if kind == "countries":
            rows = rows.withColumn("slug", F.element_at("candidates", 1))
        else:
            rows = rows.join(slugs.assign_slugs(rows.select("id", F.col("papers").alias("works"), "candidates")), "id")
        if kind == "sources":
            rows = rows.join(values.select(F.col("source").alias("id"), "best_q"), "id", "left")
        rows = filters.searchable(rows, **needs).withColumn("first_year", C.first_active_year(F.col("papers_yearly"), first))
        out[kind] = ranking.ranked(rows.select("id", "name", "extension", "slug", "papers", "citations", "papers_yearly", "citations_yearly", "first_year"))
    return out


def named_relations(relations: DataFrame, kind_of: dict[int, str], names: dict[str, DataFrame], entities: dict[str, DataFrame]) -> DataFrame:
    """``prime_lists`` rows with the related one's kind, name and slug; a name that is not known is "Unknown", a slug of one without a page is empty."""
    every = None
    for rel_type, kind in kind_of.items():
        known = names[kind].select(F.col("id").cast("string").alias("related"), "name")
        slug = entities[kind].select(F.col("id").cast("string").alias("related"), "slug") if kind in entities else known.select("related", F.lit("").alias("slug")).limit(0)
        rows = relations.filter(F.col("rel_type") == rel_type).join(known, "related", "left").join(slug, "related", "left")
        rows = rows.select("entity", "rel_type", F.lit(kind).alias("kind"), "related", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("slug", F.lit("")).alias("slug"), "score", "rank")
        every = rows if every is None else every.unionByName(rows)
    return every


def build_service(t: dict[str, DataFrame], config: Config, path: str):
    """From split records to a service: every step is written under ``path`` and read again.

    ``t`` has the tables of ``split_works``, of the other entities (``entity_rows``) and source_quartiles.
    """
    from .api import Service

    put = lambda tables, name: build.write_tables(tables, f"{path}/{name}")
    kept = put(build.filter_tables(t, config), "kept")
    planned = build.build_graph(t, kept, config)
    build.write_graph(planned, f"{path}/graph")
    graph = build.read_graph(t["works"].sparkSession, f"{path}/graph", planned)
    statistics = put(build.entity_statistics(graph, config), "statistics")
    names = put(entity_names(t), "names")
    values = written(source_values(graph, t), "source_values")
    graph = with_labels(graph, statistics, names, filters.within(t["works"], kept["works"], "id"))
    graph = replace(graph, baselines=put(graph.baselines, "baselines"), labels=put(graph.labels, "labels"))
    entities = put(entity_tables(statistics, names, values, config), "entities")
    kinds = {k: kind for k, (kind, _) in enumerate(PRIME_LISTS)}
    prime = put({kind: named_relations(prime_lists(graph, kind, values), kinds, names, entities) for kind in SHOWN}, "prime")
    institutions = names["institutions"].select(F.col("id").alias("inst"), "name")
    relations = {k: rows.join(institutions, "inst", "left") for k, rows in build.entity_relations(graph, config).items() if k in SHOWN}
    return Service(entities, graph, put(relations, "relations"), prime=prime)
