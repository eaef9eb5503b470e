"""The serving surface as functions that return frames: search, pages, views, ids, trees, counts, highlights."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, labels, ranking, search, similar
from . import trees

TREE_QUERY = {"year": None, "tid": 0, "shallow": None}


@dataclass
class Service:
    """entities[kind]: ranked frame with id, name, extension, slug, papers, citations, rank; index[kind]: search index; graph: links."""

    entities: dict[str, DataFrame]
    graph: trees.Graph
    relations: dict[str, DataFrame] = field(default_factory=dict)
    index: dict[str, DataFrame] = field(default_factory=dict)
    prime: dict[str, DataFrame] = field(default_factory=dict)  # top lists with names

    def __post_init__(self):
        for kind, rows in self.entities.items():
            named = rows.select("rank", F.trim(F.concat_ws(" ", "name", "extension")).alias("name"))
            self.index.setdefault(kind, search.build_index(named))

    def names(self, kind: str, q: str) -> DataFrame:
        """Up to 16 search results, best first."""
        found = search.search(self.index[kind], q)
        rows = found.join(self.entities[kind], "rank").orderBy("partial", "rank")
        return rows.select(F.trim(F.concat_ws(" ", "name", "extension")).alias("name"), "slug", "papers", "citations", "rank", "partial")

    def slice(self, kind: str, start: int, end: int) -> DataFrame:
        return ranking.page(self.entities[kind], start, end).orderBy("rank")

    def slug_of(self, kind: str, entity: int) -> DataFrame:
        return self.entities[kind].filter(F.col("id") == entity).select("slug")

    def view(self, kind: str, slug: str, similars: int = 8, seed: int = 0) -> dict[str, DataFrame]:
        """The entity (with its yearly arrays and first year), its institutions and top lists with names, and ``similars`` of its nearest, drawn by seed.

        Nearest are a twentieth of all of the kind, 500 at most and itself among them; it is left out of what was drawn. Where that is no more than
        ``similars``, the nearest others themselves are shown.
        """
        rows = self.entities[kind]
        entity = rows.filter(F.col("slug") == slug)
        found = entity.select("id", "rank").first()
        if found is None:
            raise KeyError(slug)
        pool = similar.neighbourhood_size(rows.count())
        plane = similar.standardized(rows.select(F.col("rank").alias("id"), "papers", "citations"))
        drawn = similar.nearest(plane, found["rank"], similars if pool <= similars else pool - 1).select("id")
        if pool > similars:
            own = rows.filter(F.col("rank") == found["rank"]).select(F.col("rank").alias("id"))
            drawn = ranking.sample(drawn.unionByName(own), similars, seed).filter(F.col("id") != found["rank"])
        out = {"entity": entity, "similar": rows.join(drawn.withColumnRenamed("id", "rank"), "rank").select("id", "name", "slug", "papers", "citations", "rank").orderBy("rank")}
        if kind in self.relations:
            out["relations"] = self.relations[kind].filter(F.col("entity") == found["id"]).orderBy("rank")
        if kind in self.prime:
            out["prime"] = self.prime[kind].filter(F.col("entity") == found["id"]).orderBy("rel_type", "rank")
        return out

    def tree(self, kind: str, slug: str, tid: int = 0, year: int | None = None, shallow: int | None = None) -> DataFrame:
        found = self.entities[kind].filter(F.col("slug") == slug).select("id").first()
        if found is None:
            raise KeyError(slug)
        g = trees.GENERATORS[trees.TREES[kind][tid]]
        nodes = trees.pruned_tree(self.graph, kind, found["id"], tid, year, shallow=shallow)
        kinds = trees.level_kinds(g)
        return labels.attach(nodes, trees.level_names(g), {d: self.graph.labels[k] for d, k in enumerate(kinds) if k in self.graph.labels})

    def counts(self) -> DataFrame:
        return ranking.entity_counts(**self.entities)

    def tops(self, kind: str, ids=(), n: int = 5, seed: int = 0) -> DataFrame:
        return ranking.sample(filters.highlighted(self.entities[kind], ids), n, seed)

    @staticmethod
    def specs() -> list[dict]:
        return trees.specs()
