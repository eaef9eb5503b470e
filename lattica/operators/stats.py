"""Per-entity statistics: counts, histograms, yearly series, h-index, co-occurrence, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def citing_counts(citing: DataFrame) -> DataFrame:
    """(work, citations) from (work, citing work) links, duplicates counted."""
    return citing.groupBy("work").agg(F.count("*").alias("citations"))


def work_counts(entity_works: DataFrame) -> DataFrame:
    """(entity, papers) from (entity, work)."""
    return entity_works.groupBy("entity").agg(F.count("*").alias("papers"))


def cite_counts(entity_works: DataFrame, citations: DataFrame) -> DataFrame:
    """(entity, citations): sum over its works."""
    return entity_works.join(citations, "work").groupBy("entity").agg(F.sum("citations").cast("long").alias("citations"))


def histogram(entity_works: DataFrame, work_classes: DataFrame) -> DataFrame:
    """(entity, class, n): how many (work, class) rows each entity has."""
    return entity_works.join(work_classes, "work").groupBy("entity", "class").agg(F.count("*").alias("n"))


def citing_histogram(entity_works: DataFrame, citing: DataFrame, work_classes: DataFrame) -> DataFrame:
    """(entity, class, n): classes of the works that cite its works."""
    links = entity_works.join(citing, "work").select("entity", F.col("citing").alias("work"))
    return histogram(links, work_classes)


def yearly(rows: DataFrame, last_year: int, years: int) -> DataFrame:
    """(entity, series): counts of the last ``years`` years, oldest first, from (entity, year)."""
    first = last_year - years + 1
    counts = [F.count(F.when(F.col("year") == y, 1)) for y in range(first, last_year + 1)]
    return rows.groupBy("entity").agg(F.array(*counts).alias("series"))


def h_and_median(counts: DataFrame, by: list[str], standard: bool = False) -> DataFrame:
    """(by..., h, upper_median) of a column ``c``.

    h is the first place, counted from 0 in descending order, whose place exceeds its count, or the number of rows;
    so [1, 1] has 2 and [0] has 1. With ``standard`` it is the usual h-index. The upper median is the middle
    value of the ascending order, the later of two.

    Equal counts of a group are added up first, so a window sees the distinct counts of a group and never its rows.
    """
    group = Window.partitionBy(*by)
    rows = counts.groupBy(*by, "c").agg(F.count("*").alias("m"))
    rows = rows.withColumn("end", F.sum("m").over(group.orderBy(F.desc("c")))).withColumn("n", F.sum("m").over(group))
    start = F.col("end") - F.col("m")
    beyond = F.when(F.col("c").isNotNull(), F.greatest(start, F.col("c") if standard else F.col("c") + 1))
    middle = F.col("n") - 1 - F.floor(F.col("n") / 2)
    return rows.groupBy(*by).agg(
        F.coalesce(F.min(F.when(beyond < F.col("end"), beyond)), F.max("n")).cast("long").alias("h"),
        F.max(F.when((start <= middle) & (middle < F.col("end")), F.col("c"))).cast("long").alias("upper_median"),
    )


def h_of_groups(counts: DataFrame, by: list[str], low: int = 8) -> DataFrame:
    """(by..., h) as of ``h_and_median``, for very many groups that are mostly small; ``c`` is not null."""
    return h_by_sums(counts.select(*by, "c", F.lit(0).cast("long").alias("beyond")).unionByName(h_beyond(counts, by, low)), by, low)


def h_beyond(counts: DataFrame, by: list[str], low: int) -> DataFrame:
    """(by..., c, beyond): of groups with an h of over ``low`` that h, which their rows of ``low`` or more alone decide; c is null."""
    return h_and_median(counts.filter(F.col("c") >= low), by).filter(F.col("h") > low).select(*by, F.lit(None).cast("long").alias("c"), F.col("h").alias("beyond"))


def h_by_sums(rows: DataFrame, by: list[str], low: int) -> DataFrame:
    """(by..., h) from rows (by..., c, beyond) with those of ``h_beyond``: h is the first k that no more than k rows reach, so up to ``low`` it is told by sums, which need no sort."""
    reach = [F.count("c").alias("__0"), *[F.count(F.when(F.col("c") >= k, 1)).alias(f"__{k}") for k in range(1, low)]]
    h = F.coalesce(*[F.when(F.col(f"__{k}") <= k, F.lit(k)) for k in range(low)], F.greatest("beyond", F.lit(low)))
    return rows.groupBy(*by).agg(*reach, F.max("beyond").alias("beyond")).select(*by, h.cast("long").alias("h"))


def source_stats(work_sources: DataFrame, citations: DataFrame, work_years: DataFrame, quartiles: DataFrame) -> DataFrame:
    """(source, h, upper_median, best_q, value): value = (5 - best_q) * h * 2 + upper_median * 3; no quartile counts as 5."""
    rows = work_sources.select("work", "source").join(citations, "work", "left").join(work_years, "work").join(quartiles, ["source", "year"], "left")
    rows = rows.withColumn("c", F.coalesce("citations", F.lit(0)))
    measures = h_and_median(rows, ["source"])
    best = rows.groupBy("source").agg(F.coalesce(F.min(F.nullif(F.col("q"), F.lit(0))), F.lit(5)).alias("best_q"))
    return measures.join(best, "source").withColumn("value", ((F.lit(5) - F.col("best_q")) * F.col("h") * 2 + F.col("upper_median") * 3).cast("long"))


def quartile_citations(work_sources: DataFrame, citations: DataFrame, work_years: DataFrame, quartiles: DataFrame) -> DataFrame:
    """(q, citations): citations of works per quartile, each work once in a quartile; unknown is 0."""
    rows = work_sources.select("work", "source").join(work_years, "work").join(quartiles, ["source", "year"], "left")
    once = rows.select(F.coalesce("q", F.lit(0)).alias("q"), "work").distinct()
    return once.join(citations, "work").groupBy("q").agg(F.sum("citations").cast("long").alias("citations"))


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def top_related(counts: DataFrame, n: int, same_kind: bool = False) -> DataFrame:
    """(entity, related, score, rank): highest scores first, then the lower id; the unknown, and itself among its own kind, left out."""
    rows = counts.filter("related is not null")
    if same_kind:
        rows = rows.filter("related <> entity")
    return top_n(rows, ["entity"], [F.desc("score"), F.col("related")], n)


def top_by_value(counts: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """Like ``top_related``, but ordered by a value of the related one (related, value); the count stays the score."""
    rows = counts.filter("related is not null").join(values, "related", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    return top_n(rows, ["entity"], [F.desc("value"), F.desc("score"), F.col("related")], n)


def top_by_h(entity_related_counts: DataFrame, n: int) -> DataFrame:
    """(entity, related, score, rank): score is the h-index of the related one's works within the entity (entity, related, c)."""
    scored = h_and_median(entity_related_counts, ["entity", "related"]).select("entity", "related", F.col("h").alias("score"))
    return top_related(scored, n)


def institution_relations(rows: DataFrame, n: int = 8) -> DataFrame:
    """The n strongest institutions of an entity: papers, citations, first and last year; from (entity, inst, citations, year)."""
    found = rows.filter("inst is not null").groupBy("entity", "inst").agg(
        F.count("*").alias("papers"), F.sum("citations").cast("long").alias("citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
    span = F.col("last_year") - F.col("first_year")
    return top_n(found, ["entity"], [F.desc("papers"), span.desc(), F.col("inst")], n)


def country_institutions(country_works: DataFrame, work_institutions: DataFrame, countries: DataFrame) -> DataFrame:
    """(entity, work, inst): of a country's works, the institutions in that country only; countries has inst, country."""
    at_home = work_institutions.join(countries, "inst").select("work", "inst", F.col("country").alias("entity"))
    return country_works.join(at_home, ["entity", "work"]).select("entity", "work", "inst")


def author_institutions(author_works: DataFrame, affiliations: DataFrame) -> DataFrame:
    """(entity, work, inst): of an author's works, the institutions of that author only; affiliations has work, author, inst."""
    own = affiliations.select(F.col("author").alias("entity"), "work", "inst")
    return author_works.join(own, ["entity", "work"]).select("entity", "work", "inst")


def cooccurrence(rows: DataFrame, most_items: int = 1000) -> DataFrame:
    """(a, b, n): in how many groups the items a < b occur together, from (group, item).

    Items are first made distinct within groups. A group of over ``most_items`` is dealt to blocks of about so many, and each
    pair of blocks is a row of its own, so no task holds the pairs of a whole group. Pairs are counted before they are shuffled.
    """
    items = rows.filter("item is not null").distinct()
    blocks = items.groupBy(F.col("group").alias("of")).agg(F.ceil(F.count("*") / most_items).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    dealt = items.join(blocks, F.col("group").eqNullSafe(F.col("of"))).select("group", "item", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    ends = dealt.select("group", "item", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    lists = ends.groupBy("group", "low", "high").agg(
        F.sort_array(F.collect_list(F.when(F.col("own") == F.col("low"), F.col("item")))).alias("left"), F.collect_list(F.when(F.col("own") > F.col("low"), F.col("item"))).alias("right")
    )
    firsts = lists.select(F.posexplode("left").alias("at", "x"), "left", "right", (F.col("low") == F.col("high")).alias("same"))
    partners = F.when(F.col("same"), F.slice("left", F.col("at") + 2, F.size("left"))).otherwise(F.col("right"))
    pairs = firsts.select("x", F.explode(partners).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def prime_relations(*tops: DataFrame) -> DataFrame:
    """(entity, rel_type, related, score, rank) of several top lists, numbered in the order given."""
    out = None
    for k, top in enumerate(tops):
        rows = top.filter("related is not null").select("entity", F.lit(k).alias("rel_type"), "related", "score", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out
