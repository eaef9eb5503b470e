"""Breakdown trees: which attributes of the referenced and the citing work make the levels, and for which root.

A generator is a list of steps; each joins a table of attributes to the referenced ("r") or the citing ("c") work and yields levels.
A graph has a table per attribute and side, so that the two sides may be different kinds of work.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import lists
from ..operators import prune as pruning
from ..operators.ranking import numbered
from ..operators.rollup import Extent, extent, in_periods, new_prefixes, per_prefix
from ..scratch import written


@dataclass
class Graph:
    """citing (ref, cit); years (ref, year); tables[(side, attribute)] with column work and the attribute's columns;
    roots[kind] (entity, work); baselines[entity kind] (key, baseline); labels[entity kind] (key, name)."""

    citing: DataFrame
    years: DataFrame
    tables: dict[tuple[str, str], DataFrame]
    roots: dict[str, DataFrame]
    year_filters: tuple[int, ...] = ()
    baselines: dict[str, DataFrame] = field(default_factory=dict)
    labels: dict[str, DataFrame] = field(default_factory=dict)
    extent: Extent | None = None  # of citing or what it comes from; found if not known

    def size(self) -> Extent:
        return self.extent or extent(self.citing)


#: attribute -> its columns, in the order of its table
ATTRIBUTES = {
    "subfield": ["subfield"], "topic": ["topic"], "subfield_topic": ["subfield", "topic"], "source": ["source"], "country": ["country"],
    "country_inst": ["country", "inst"], "inst": ["inst"], "author": ["author"], "quartile_source": ["quartile", "source"], "author_inst": ["author", "inst"],
}


@dataclass(frozen=True)
class Step:
    side: str
    attribute: str
    exclude_root: str | None = None  # a column that must differ from the root (null stays)
    root_value: str | None = None  # a column that must equal the root
    drop_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Generator:
    """levels: (entity kind, step number or "work", column); denominators: depth that divides each level's links; specialised: is it shown."""

    name: str
    steps: tuple[Step, ...]
    levels: tuple[tuple[str, int | str, str], ...]
    denominators: tuple[int, ...]
    specialised: bool = True
    member_first: bool = False  # institutions of the root country come first


def _g(name, steps, levels, denominators, specialised=True, member_first=False):
    return Generator(name, tuple(steps), tuple(levels), tuple(denominators), specialised, member_first)


r = lambda a, **k: Step("r", a, **k)
c = lambda a, **k: Step("c", a, **k)
_ci = [("country", "country"), ("inst", "inst")]


def _at(step, *columns):
    return [(col, step, col) for col in columns]


GENERATORS = {
    g.name: g
    for g in [
        _g("subfield_country_inst", [r("subfield"), c("country_inst")], _at(0, "subfield") + _at(1, "country", "inst"), (0, 1, 1)),
        _g("source_subfield_country", [r("source"), r("subfield"), c("country")], _at(0, "source") + _at(1, "subfield") + _at(2, "country"), (0, 1, 2), False),
        _g("ref_source_country_inst", [r("source"), r("country_inst")], _at(0, "source") + _at(1, "country", "inst"), (0, 1, 1)),
        _g("ref_country_inst_subfield", [r("country_inst"), r("subfield")], _at(0, "country", "inst") + _at(1, "subfield"), (0, 0, 2)),
        _g("citing_country_subfield_topic", [c("country"), c("subfield_topic")], _at(0, "country") + _at(1, "subfield", "topic"), (0, 1, 1)),
        _g("citing_country_inst_subfield_topic", [c("country_inst"), c("subfield_topic")], _at(0, "country", "inst") + _at(1, "subfield", "topic"), (0, 0, 2, 2)),
        _g("citing_source_country_subfield", [c("source"), c("country_inst"), c("subfield")], _at(0, "source") + _at(1, "country") + _at(2, "subfield"), (0, 1, 2)),
        _g("work_country_inst", [c("country_inst")], [("work", "work", "ref")] + _at(0, "country", "inst"), (0, 1, 1)),
        _g("source_work_country_inst", [r("source"), c("country_inst")], _at(0, "source") + [("work", "work", "ref")] + _at(1, "country", "inst"), (0, 0, 2, 2), False),
        _g("subfield_work_country_inst", [r("subfield"), c("country_inst")], _at(0, "subfield") + [("work", "work", "ref")] + _at(1, "country", "inst"), (0, 0, 2, 2)),
        _g("subfield_country_inst_source", [r("subfield"), c("country_inst"), c("source")], _at(0, "subfield") + _at(1, "country", "inst") + _at(2, "source"), (0, 1, 1, 3)),
        _g("subfield_country_inst_subfield", [r("subfield"), c("country_inst"), c("subfield")], _at(0, "subfield") + _at(1, "country", "inst") + _at(2, "subfield"), (0, 1, 1, 3)),
        _g("inst_subfield_country_inst", [r("inst"), r("subfield"), c("country_inst")], _at(0, "inst") + _at(1, "subfield") + _at(2, "country", "inst"), (0, 1, 2, 2)),
        _g("ref_subfield_citing_subfield_topic", [r("subfield"), c("subfield_topic")], _at(0, "subfield") + _at(1, "subfield", "topic"), (0, 1, 1)),
        _g("citing_subfield_source_topic", [c("subfield"), c("source"), c("topic")], _at(0, "subfield") + _at(1, "source") + _at(2, "topic"), (0, 1, 1)),
        _g("ref_subfield_citing_source_topic", [r("subfield"), c("source"), c("topic")], _at(0, "subfield") + _at(1, "source") + _at(2, "topic"), (0, 1, 1)),
        _g("quartile_source_subfield_country", [r("quartile_source"), c("subfield"), c("country")], _at(0, "quartile", "source") + _at(1, "subfield") + _at(2, "country"), (0, 0, 2, 3)),
        _g("partner_countries", [r("country_inst", exclude_root="country"), r("subfield")], _at(0, "country", "inst") + _at(1, "subfield"), (0, 0, 1)),
        _g("coauthor_papers", [r("author", exclude_root="author"), c("subfield")], _at(0, "author") + [("work", "work", "ref")] + _at(1, "subfield"), (0, 0, 2), False),
        _g("coauthors", [r("author", exclude_root="author"), c("country_inst")], _at(0, "author") + _at(1, "country", "inst"), (0, 1, 1), False),
        _g("partner_institutions", [r("country_inst", exclude_root="inst"), r("subfield")], _at(0, "country") + _at(1, "subfield") + _at(0, "inst"), (0, 1, 0)),
        _g("working_authors", [r("author_inst", root_value="inst"), r("country_inst")], _at(0, "author") + _at(1, "country", "inst"), (0, 1, 1), False),
        _g("topic_country_inst", [r("subfield_topic", root_value="subfield"), r("country_inst")], _at(0, "topic") + _at(1, "country", "inst"), (0, 1, 1)),
    ]
}


def members_of_country(base: str, name: str, denominators: tuple[int, ...]) -> Generator:
    """The institutions of a country first, then another generator's levels."""
    g = GENERATORS[base]
    return replace(g, name=name, member_first=True, specialised=False, denominators=denominators)


GENERATORS["country_members_subfield"] = members_of_country("subfield_country_inst", "country_members_subfield", (0, 1, 2, 2))
GENERATORS["country_members_source"] = members_of_country("source_subfield_country", "country_members_source", (0, 1, 2, 3))

#: The trees of each kind of root, in the order of their numbers.
TREES = {
    "authors": [
        "source_work_country_inst", "citing_country_subfield_topic", "subfield_country_inst_subfield", "subfield_work_country_inst",
        "ref_subfield_citing_subfield_topic", "citing_country_inst_subfield_topic", "source_subfield_country", "coauthor_papers", "coauthors",
    ],
    "institutions": [
        "ref_subfield_citing_subfield_topic", "citing_subfield_source_topic", "working_authors", "citing_source_country_subfield",
        "quartile_source_subfield_country", "citing_country_inst_subfield_topic", "partner_institutions", "subfield_country_inst_subfield", "subfield_country_inst_source",
    ],
    "countries": ["country_members_subfield", "partner_countries", "country_members_source"],
    "sources": ["subfield_country_inst_source", "ref_country_inst_subfield", "citing_source_country_subfield"],
    "subfields": ["topic_country_inst", "ref_source_country_inst"],
}


def level_names(g: Generator) -> list[str]:
    return [f"k{i + 1}" for i in range(len(g.levels) + g.member_first)]


def level_kinds(g: Generator) -> list[str]:
    return (["inst"] if g.member_first else []) + [kind for kind, _, _ in g.levels]


def specs() -> list[dict]:
    """What each tree shows: root kind, number, level kinds, and whether shares are compared to a baseline."""
    return [
        {"root": root, "tid": tid, "generator": name, "levels": level_kinds(GENERATORS[name]), "denominators": list(GENERATORS[name].denominators), "specialised": GENERATORS[name].specialised}
        for root, names in TREES.items()
        for tid, name in enumerate(names)
    ]


def _nodes(graph: Graph, works: DataFrame, by: list[str], g: Generator, own: Column, chosen: bool, year: int | None = None, many: bool = False) -> DataFrame:
    """The nodes per k1..kn and ``by``: ``per_prefix`` of rows (depth, k1..kn, by..., ref, n), distinct citing works of each work under every prefix, from works (by..., member?, ref); ``own`` is the root.

    A work's own levels and those of its citing works meet on the work alone. So prefixes of its own levels are found without its links,
    and links are counted per work and prefix of the citing works' levels, which are numbered and listed once for each citing work. A count is then
    given to each of the work's own prefixes. All is dealt by work, in parts that grow in number with the links. ``chosen``: the works are few of all;
    ``year``: they are those since. ``many``: so many values has ``by``, or the member, that a task's works share few of them. Then a work's own paths are dealt
    by these with its counts as arrays, and the prefixes are made where their works have met.
    """
    names, size = level_names(g), graph.size()
    parts = size.parts
    works = works.repartition(parts, "ref").distinct()
    rows, keys = works, ([F.col("member")] if g.member_first else [])
    for i, step in enumerate(g.steps):
        if step.side == "r":
            rows = _with_step(graph, rows, i, step, "ref", own)
    sides = ["r"] * g.member_first + ["r" if step == "work" else g.steps[step].side for _, step, _ in g.levels]
    keys += [F.col("ref") if step == "work" else F.col(f"s{step}_{col}") for _, step, col in g.levels]
    mine, theirs = ([i for i, s in enumerate(sides) if s == side] for side in ("r", "c"))
    rows = rows.select(*by, "ref", *[keys[i].alias(names[i]) for i in mine])

    links = graph.citing.select("ref", "cit").distinct()
    if chosen:
        links = links.join(works.select("ref").distinct(), "ref", "left_semi")
    elif year is not None:
        links = _since(graph, links, year)
    cited = None
    for i, step in enumerate(g.steps):
        if step.side == "c":
            cited = graph.tables["c", step.attribute].select(F.col("work").alias("cit")).distinct() if cited is None else cited
            cited = _with_step(graph, cited, i, step, "cit", own)
    if cited is None or not theirs:
        links = links if cited is None else links.join(cited.select("cit").distinct(), "cit", "left_semi")
        counts = links.repartition(parts, "ref").groupBy("ref").agg(F.count("cit").alias("n")).withColumn("__p", F.lit(0).cast("long"))
        prefixes = None
    else:
        cited, prefixes = _numbered_prefixes(cited.select("cit", *[keys[i].alias(names[i]) for i in theirs]), [names[i] for i in theirs], parts)
        nodes = links.join(cited, "cit").select("ref", "own")
        if not many:
            nodes = nodes.repartition(parts, "ref").select("ref", F.explode("own").alias("__p"))
            counts = nodes.groupBy("ref", F.col("__p").cast("long").alias("__p")).agg(F.count("*").alias("n"))
    # a prefix of all levels has so many of the work's own
    own_levels = [sum(s == "r" for s in sides[:d]) for d in range(len(sides) + 1)]
    length = F.pmod("__p", F.lit(len(theirs) + 1)).cast("int")
    own_keys = [names[i] for i in mine]
    masked = [F.when(F.col("__r") > at, F.col(k)).alias(k) for at, k in enumerate(own_keys)]
    if many:
        counts = lists.single_counts(counts) if prefixes is None else lists.count_lists(nodes, parts)
        met = new_prefixes(rows, [*by, "ref"], own_keys).join(counts, "ref")
        met = lists.each_count(met.hint("rebalance", parts, *by, *own_keys[: g.member_first]))
        # prefixes of the citing levels that are so long go with own ones of a range of lengths
        fits = [[k for d, k in enumerate(own_levels) if d - k == j] for j in range(len(theirs) + 1)]
        first, last = (F.element_at(F.array(*[F.lit(f(k)) for k in fits]), length + 1) for f in (min, max))
        first = F.greatest("__new", first)
        met = met.select("*", F.explode(F.when(first <= last, F.sequence(first, last))).alias("__r")).select((F.col("__r") + length).alias("depth"), *by, *masked, "__p", "ref", "n")
    else:
        rows = rows.select(*by, "ref", F.explode(F.sequence(F.lit(0), F.lit(len(mine)))).alias("__r"), *own_keys)
        met = rows.select(*by, "ref", "__r", *masked).distinct().join(counts, "ref").withColumn("depth", F.col("__r") + length)
        met = met.filter(F.element_at(F.array(*[F.lit(k) for k in own_levels]), F.col("depth") + 1) == F.col("__r")).select("depth", *by, *own_keys, "__p", "ref", "n")
    out = per_prefix(met, [*by, *own_keys, "__p"], size.ref_bits)
    out = out if prefixes is None else out.join(prefixes, "__p")
    return out.select("depth", *by, *names, "link_count", "source_count", "top_source", "top_source_links")


def _numbered_prefixes(paths: DataFrame, names: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """(cit, own) with the numbers of all prefixes of a work's paths, and (__p, names...) of every prefix, from rows (cit, names...).

    A number is that of one path with the prefix, times the number of levels and one, plus the prefix's length. So a prefix is one number in
    each list and count, whatever its levels are; numbers are dense, so lists are of the narrowest type that holds them.
    """
    paths = written(paths, "paths")
    every = written(numbered(paths.select(*names).distinct(), [F.col(k) for k in names], "__id"), "prefixes")
    highest = every.count() * (len(names) + 1)
    kind = lists.narrowest(highest)
    ids = every
    for d in range(1, len(names)):
        first = every.groupBy(*[F.col(k).alias(f"__{k}") for k in names[:d]]).agg(F.min("__id").alias(f"__first{d}"))
        ids = ids.join(first, _same(names[:d])).drop(*[f"__{k}" for k in names[:d]])
    number = lambda d: (F.lit(0).cast("long") if d == 0 else (F.col("__id") if d == len(names) else F.col(f"__first{d}")) * (len(names) + 1) + d)
    numbers = ids.select(*[F.col(k).alias(f"__{k}") for k in names], F.array(*[number(d) for d in range(len(names) + 1)]).cast(f"array<{kind}>").alias("numbers"))
    cited = paths.join(numbers, _same(names)).select("cit", "numbers").repartition(parts, "cit").groupBy("cit").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("own"))
    # each prefix is told by the path that gave it its number
    shown = F.filter(F.array(*[F.struct(number(d).alias("__p"), F.lit(d).alias("d"), (F.col("__id") if d in (0, len(names)) else F.col(f"__first{d}")).alias("of")) for d in range(1, len(names) + 1)]), lambda x: x["of"] == F.col("__id"))
    told = ids.select(F.explode(shown).alias("x"), *names).select("x.__p", *[F.when(F.col("x.d") > at, F.col(k)).alias(k) for at, k in enumerate(names)])
    root = every.limit(1).select(F.lit(0).cast("long").alias("__p"), *[F.when(F.lit(False), F.col(k)).alias(k) for k in names])
    return cited, told.unionByName(root)


def _same(names: list[str]) -> Column:
    """The columns equal those of the same names after two underscores; null is a value."""
    return reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__{k}")), names[1:], F.col(names[0]).eqNullSafe(F.col(f"__{names[0]}")))


def _with_step(graph: Graph, rows: DataFrame, i: int, step: Step, on: str, own: Column) -> DataFrame:
    """The rows joined with the attributes of a step, as columns s<i>_<attribute>."""
    columns = ATTRIBUTES[step.attribute]
    rows = rows.join(graph.tables[step.side, step.attribute].select(F.col("work").alias(on), *[F.col(a).alias(f"s{i}_{a}") for a in columns]), on)
    if step.exclude_root:
        other = F.col(f"s{i}_{step.exclude_root}")
        rows = rows.filter(other.isNull() | (other != own))
    if step.root_value:
        rows = rows.filter((F.col(f"s{i}_{step.root_value}") == own) & F.col(f"s{i}_{columns[0]}").isNotNull())
    return rows


def _works(graph: Graph, root: str, entity, g: Generator) -> DataFrame:
    """(ref) of one entity, or (member, ref) of a country's members."""
    if not g.member_first:
        return graph.roots[root].filter(F.col("entity") == entity).select(F.col("work").alias("ref"))
    members = graph.tables["r", "inst_country"].filter(F.col("country") == entity).select(F.col("inst").alias("entity"))
    return graph.roots["institutions"].join(members, "entity").select(F.col("entity").alias("member"), F.col("work").alias("ref"))


def _since(graph: Graph, works: DataFrame, year: int | None) -> DataFrame:
    years = graph.years if year is None else graph.years.filter(F.col("year") >= year)
    return works.join(years.select("ref"), "ref", "left_semi")


def forest(graph: Graph, root: str, tid: int = 0, year: int | None = None) -> DataFrame:
    """The rollup of one tree for all entities of a kind at once: a column ``root`` before those of ``tree``. An entity without links has no rows.

    Tasks hold works, not roots, and what they found for a root is added up before it is shuffled.
    """
    g = GENERATORS[TREES[root][tid]]
    if g.member_first:
        country = graph.tables["r", "inst_country"].select(F.col("inst").alias("entity"), F.col("country").alias("root"))
        works = graph.roots["institutions"].join(country, "entity").select("root", F.col("entity").alias("member"), F.col("work").alias("ref"))
    else:
        works = graph.roots[root].select(F.col("entity").alias("root"), F.col("work").alias("ref"))
    works = _since(graph, works.filter("root is not null"), year)
    return _nodes(graph, works, ["root"], g, F.col("root"), False, year, g.member_first)


def pruned_forest(graph: Graph, root: str, tid: int = 0, year: int | None = None, siblings: int = 16) -> DataFrame:
    """``pruned_tree`` for all entities of a kind at once."""
    g = GENERATORS[TREES[root][tid]]
    baselines = {d: graph.baselines[kind] for d, kind in enumerate(level_kinds(g)) if kind in graph.baselines}
    return pruning.prune(forest(graph, root, tid, year), level_names(g), list(g.denominators), baselines, siblings, by=("root",))


def tree(graph: Graph, root: str, entity, tid: int = 0, year: int | None = None) -> DataFrame:
    """The whole rollup of one tree, of works of ``year`` or later."""
    g = GENERATORS[TREES[root][tid]]
    works = _since(graph, _works(graph, root, entity, g), year)
    return _nodes(graph, works, [], g, F.lit(entity), True)


def tree_all_periods(graph: Graph, root: str, entity, tid: int = 0) -> DataFrame:
    from ..functions.columns import period

    g = GENERATORS[TREES[root][tid]]
    works = _works(graph, root, entity, g).join(graph.years.select("ref", period(F.col("year"), graph.year_filters).alias("period")), "ref")
    return in_periods(_nodes(graph, works, ["period"], g, F.lit(entity), True), level_names(g), len(graph.year_filters))


def pruned_tree(graph: Graph, root: str, entity, tid: int = 0, year: int | None = None, siblings: int = 16, shallow: int | None = None) -> DataFrame:
    """The tree with only the largest and most specialised children of each node."""
    g = GENERATORS[TREES[root][tid]]
    whole = tree(graph, root, entity, tid, year)
    baselines = {d: graph.baselines[kind] for d, kind in enumerate(level_kinds(g)) if kind in graph.baselines}
    out = pruning.prune(whole, level_names(g), list(g.denominators), baselines, siblings)
    return out if shallow is None else pruning.cut(out, shallow)
