"""From raw records to a service: entity tables, top lists, baselines, labels, trees and views."""

import pytest
from pyspark.sql import functions as F
from test_reference import nodes, raw_records

from lattica.config import Config
from lattica.operators import prune
from lattica.plans import entities, trees
from lattica.sources import records


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("build")
    raw_records(folder)
    read = lambda e: records.read_records(spark, str(folder / e), e)
    t = records.split_works(read("works"))
    t |= {e: records.entity_rows(read(e), e) for e in ("authors", "institutions", "topics")}
    t["subfields"] = spark.createDataFrame([(10, "Field ten", 1), (20, "Field ten", 1)], "id long, name string, field long")
    t["sources"] = spark.createDataFrame([(1, "Journal of Tests", None, [], ["JT"], "J Tests", "JT"), (2, "Letters", None, [], None, None, "")], "id long, name string, issn_l string, issn array<string>, alternate_titles array<string>, abbreviated_title string, name_extension string")
    t["source_quartiles"] = spark.createDataFrame([(2015, 1, 2), (2018, 2, 1)], "publication_year int, id long, best_q int")
    config = Config(min_papers_source=1, min_papers_institution=1)
    return entities.build_service(t, config, str(folder / "out")), config


def test_entities_have_names_slugs_and_ranks(built):
    service, config = built
    authors = [(r.rank, r.id, r.name, r.slug, r.papers, r.citations, r.first_year) for r in service.entities["authors"].orderBy("rank").collect()]
    assert authors == [(0, 1, "Author 1", "author", 2, 3, 2015)]
    institutions = [(r.id, r.name, r.slug) for r in service.entities["institutions"].orderBy("id").collect()]
    assert [i[:2] for i in institutions] == [(1, "Same (C1)"), (2, "Same (C2)")]  # the country is shared too
    assert len({i[2] for i in institutions}) == len(institutions) and all(i[2] for i in institutions)
    assert service.entities["sources"].count() == 0  # too few papers
    series = service.entities["authors"].first()
    assert sum(series.papers_yearly) == 2 and series.citations_yearly[2018 - 2015] == 2
    assert [r.slug for r in service.names("authors", "auth").collect()] == ["author"]


def test_baselines_and_labels_are_those_of_the_statistics(built):
    service, _ = built
    cites = {r.entity: r.citations for r in service.graph.roots["subfields"].join(service.graph.citing, F.col("work") == F.col("ref")).groupBy("entity").agg(F.count("*").alias("citations")).collect()}
    n = service.graph.roots["subfields"].select("entity").distinct().count()
    total = sum(cites.values())
    got = {r.key: r.baseline for r in service.graph.baselines["subfield"].collect()}
    assert len(got) == n and all(abs(got[k] - (0.55 * cites.get(k, 0) + 0.45 * total / n) / total) < 1e-12 for k in got)
    assert {r.key: r.name for r in service.graph.labels["quartile"].collect()}.get(2) == "Q2"


def test_tree_is_pruned_by_baselines_and_named(built):
    service, _ = built
    slug = service.entities["authors"].first().slug
    for tid in (3, 5):
        g = trees.GENERATORS[trees.TREES["authors"][tid]]
        keys = trees.level_names(g)
        whole = trees.tree(service.graph, "authors", 1, tid)
        base = {d: service.graph.baselines[k] for d, k in enumerate(trees.level_kinds(g)) if k in service.graph.baselines}
        assert base
        want = nodes(prune.prune(whole, keys, list(g.denominators), base), keys)
        got = service.tree("authors", slug, tid)
        assert nodes(got.drop("label"), keys) == want
        names = {k: {r.key: r.name for r in service.graph.labels[k].collect()} for k in set(trees.level_kinds(g))}
        for row in got.collect():
            kind = trees.level_kinds(g)[row.depth - 1] if row.depth else None
            assert row.label == (names[kind].get(row[keys[row.depth - 1]], "Unknown") if kind else None)


def test_view(built):
    service, _ = built
    view = service.view("authors", "author")
    assert view["entity"].first().citations == 3 and view["similar"].count() == 0  # one author has no twentieth
    assert [(r.inst, r.name, r.papers) for r in view["relations"].orderBy("rank").collect()][0] == (1, "Same (C1)", 2)
    prime = {(r.rel_type, r.kind, r.related): (r.name, r.score) for r in view["prime"].collect()}
    assert prime[0, "subfields", "10"] == ("Field ten", 2) and prime[1, "subfields", "20"][1] == 2 and prime[2, "topics", "1"] == ("Topic 1", 2)
    assert prime[3, "countries", "FR"][1] == 2 and prime[5, "authors", "2"][0] == "Author 2" and (5, "authors", "1") not in prime
    with pytest.raises(KeyError):
        service.view("authors", "nobody")


def test_similar_entities_of_a_view(spark):
    from lattica.operators import ranking
    from lattica.plans import api

    rows = spark.createDataFrame([(i, f"N{i}", "", f"n-{i}", 1 + i % 9, 3 * i) for i in range(1, 401)], "id long, name string, extension string, slug string, papers long, citations long")
    edges = spark.createDataFrame([(1, 2)], "ref long, cit long")
    service = api.Service({"authors": ranking.ranked(rows)}, trees.Graph(edges, edges, {}, {}))
    once, again = ([r.id for r in service.view("authors", "n-50", seed=s)["similar"].collect()] for s in (1, 1))
    assert once == again and 7 <= len(once) <= 8 and 50 not in once  # eight of the twenty nearest, itself among them
