"""Golden vectors and laws of the graph operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lattica.config import Config
from lattica.functions import columns as C
from lattica.operators import filters, links, prune, ranking, rollup, search, similar, slugs, stats
from lattica.plans import api, build, trees
from lattica.sources import records

L2 = [(30, 20, 10, 0), (30, 20, 10, 1), (30, 20, 10, 2), (30, 21, 10, 0), (30, 21, 11, 0), (31, 21, 11, 0), (31, 20, 12, 0), (31, 20, 12, 0), (31, 21, 13, 0), (31, 21, 13, 1), (31, 21, 13, 2), (31, 21, 13, 3), (31, 21, 14, 0), (31, 21, 14, 1), (31, 21, 11, 1)]


def nodes(frame, keys):
    return {tuple(r[k] for k in keys)[: r.depth]: (r.source_count, r.link_count, r.top_source, r.top_source_links) for r in frame.collect()}


def test_two_level_rollup(spark):
    got = nodes(rollup.rollup(spark.createDataFrame(L2, "k1 int, k2 int, ref long, cit long"), ["k1", "k2"]), ["k1", "k2"])
    assert got[()] == (5, 12, 13, 4)
    assert got[30, 21][:2] == (2, 2) and got[31, 20][:2] == (1, 1)


@pytest.mark.parametrize("rows", [[(0, 10, 101), (1, 10, 100), (1, 11, 100)], [(1, 0, 1), (0, 1, 0), (0, 0, 0)]])
def test_one_level_rollup(spark, rows):
    got = nodes(rollup.rollup(spark.createDataFrame(rows, "k1 int, ref long, cit long"), ["k1"]), ["k1"])
    assert got[()][:2] == (2, 3)


def test_rollup_of_nothing(spark):
    assert rollup.rollup(spark.createDataFrame([], "k1 int, ref long, cit long"), ["k1"]).filter("depth > 0").count() == 0


def test_periods_agree_with_year_filters(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.choice([None, 1, 2]), rng.randrange(60), rng.randrange(20)) for _ in range(1500)]
    years = (2000, 2005, 2010, 2012)
    frame = spark.createDataFrame([(*r, 2000 + r[2] % 15) for r in rows], "k1 int, k2 int, ref long, cit long, year int")
    every = rollup.rollup_periods(frame.withColumn("period", C.period(F.col("year"), years)), ["k1", "k2"], len(years)).collect()
    previous = None
    for p, y in enumerate(years):
        direct = {(r.depth, r.k1, r.k2): (r.link_count, r.source_count, r.top_source, r.top_source_links) for r in rollup.rollup(rollup.since_year(frame, y), ["k1", "k2"]).collect()}
        assert {(r.depth, r.k1, r.k2): (r.link_count, r.source_count, r.top_source, r.top_source_links) for r in every if r.period == p} == direct
        assert previous is None or all(previous[k][0] >= v[0] for k, v in direct.items())
        previous = direct
    for (depth, k1, _), (n, s, _, _) in previous.items():
        assert s <= n
        if depth == 1:
            assert n <= sum(v[0] for (d, a, _), v in previous.items() if d == 2 and a == k1)


def naive_prune(tree, keys, denominators, baseline, siblings):
    kept, out = {()}, [()]
    for d in range(len(keys)):
        following = set()
        for parent in kept:
            children = [k for k in tree if len(k) == d + 1 and k[:d] == parent]
            spec = lambda k: tree[k] / tree[k[: denominators[d]]] / baseline.get(d, {}).get(k[d], 1.0)  # noqa: B023, E731
            if len(children) > siblings:
                children = [k for k in children if k[d] is not None]
                best = lambda f: set(sorted(children, key=lambda k: (f(k), k[d]), reverse=True)[:siblings])  # noqa: B023, E731
                children = best(tree.get) | best(spec)
            following |= set(children)
        kept = following
        out += kept
    return set(out)


def test_prune_keeps_large_and_special_children(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(7)]), rng.choice([None, *range(9)]), rng.randrange(200), rng.randrange(30)) for _ in range(2500)]
    whole = rollup.rollup(spark.createDataFrame(rows, "k1 int, k2 int, ref long, cit long"), ["k1", "k2"])
    tree = {tuple((r.k1, r.k2))[: r.depth]: r.link_count for r in whole.collect()}
    base = {1: {k: 0.05 + 0.1 * k for k in range(9)}}
    frame = spark.createDataFrame(list(base[1].items()), "key int, baseline double")
    for denominators in ([0, 0], [0, 1]):
        got = {tuple((r.k1, r.k2))[: r.depth] for r in prune.prune(whole, ["k1", "k2"], denominators, {1: frame}, siblings=3).collect()}
        assert got == naive_prune(tree, ["k1", "k2"], denominators, base, 3)


def h(spark, values, **kw):
    return stats.h_and_median(spark.createDataFrame([(1, v) for v in values], "e int, c int"), ["e"], **kw).first()


def test_h_and_median(spark):
    assert [h(spark, v).h for v in ([5, 4, 1], [1, 1], [0])] == [2, 2, 1]
    assert h(spark, [5, 4, 1], standard=True).h == 2 and h(spark, [1, 1], standard=True).h == 1
    assert h(spark, [1, 2, 3, 4]).upper_median == 3


def test_periods_of_years(spark):
    years = spark.createDataFrame([(y,) for y in (1950, 2010, 2014, 2021, 2025)], "y int")
    assert [r[0] for r in years.select(C.period(F.col("y"), Config().year_filters)).collect()] == [0, 1, 1, 4, 7]


def test_link_laws(spark):
    edges = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (1, 10), (3, None)], "src long, dst long")
    assert sorted(map(tuple, links.invert(links.invert(edges)).collect())) == [(1, 10), (1, 10), (1, 11), (2, 10)]
    second = spark.createDataFrame([(10, 7), (11, 7), (11, None)], "src long, dst long")
    assert sorted(map(tuple, links.collapse(edges, second).collect()), key=str) == [(1, 7), (1, None), (2, 7)]
    assert {r.src: r.dsts for r in links.group_invert(edges).collect()} == {10: [1, 1, 2], 11: [1]}
    assert sorted(map(tuple, links.dense_ids(spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "k string"), "k", 3).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    first = links.first_wins(spark.createDataFrame([(20, 1, 0), (30, 2, 1), (20, 3, 2), (40, 10, 3), (0, 7, 4)], "k int, v int, at int"), "k", "at")
    assert {r.k: r.v for r in first.collect()} == {20: 1, 30: 2, 40: 10, 0: 7}


def test_degree_filter(spark):
    edges = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, None), (4, 1), (4, 2), (4, 3)], "src int, dst int")
    ids = lambda f: sorted(r[0] for r in f.collect())
    assert ids(filters.degree_filter(edges, least=2)) == [1, 4]
    assert ids(filters.degree_filter(edges, most=2)) == [1, 2]
    targets = spark.createDataFrame([(1,), (2,)], "id int")
    assert ids(filters.degree_filter(edges, least=2, most=2, targets=targets)) == [1, 4]


def test_cooccurrence_in_blocks(spark):
    rng = random.Random(8)
    rows = [(g, rng.randrange(40)) for g in (1, 2, None) for _ in range(60)] + [(3, 5), (3, None), (4, 1), (4, 2), (4, 2)]
    frame = spark.createDataFrame(rows, "group int, item int")
    wanted = {}
    for group in {g for g, _ in rows}:
        items = sorted({i for g, i in rows if g == group and i is not None})
        for a, b in ((a, b) for a in items for b in items if a < b):
            wanted[a, b] = wanted.get((a, b), 0) + 1
    for most in (7, 1000):
        assert {(r.a, r.b): r.n for r in stats.cooccurrence(frame, most).collect()} == wanted


def test_names(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "s string").select(c(F.col("s"))).first()[0]
    assert one(C.slug, "  Université de Genève (CH)  2nd ") == "universite-de-geneve-ch-nd"
    assert one(C.slug, "a" * 250 + " bbbbb cccccc d") == "a" * 250 + "-bbbbb" and one(C.slug, None) == ""
    assert one(C.slug, " ".join(["x"] * 40)) == "-".join(["x"] * 32)
    assert one(C.journal_name, "Journal of Things/Journal of Thing") == "Journal of Things"
    assert one(C.journal_name, "Short/Shirt") == "Short/Shirt" and one(C.journal_name, "A long title/Something else") == "A long title/Something else"
    assert one(C.url_number, "https://host/W123") == 123 and one(C.last_segment, "https://host/fields/27") == 27
    assert one(C.json_strings, '["a","b c"]') == "a b c" and one(C.split_list, "a;;b") == ["a", "b"]


def test_slug_assignment(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), [rng.choice(["a", "b", "c", "foo-2", "foo"]) for _ in range(rng.randrange(0, 3))]) for i in range(60)] + [(100, 9, None), (101, 1, ["alone"])]
    got = {r.id: r.slug for r in slugs.assign_slugs(spark.createDataFrame(rows, "id long, works int, candidates array<string>")).collect()}
    taken, wanted = set(), {}
    for i, _, names in sorted(rows, key=lambda r: (-r[1], -r[0])):
        options = [*names, *(f"{names[-1]}-{s}" for s in slugs.SUFFIXES)] if names else []
        wanted[i] = next((o for o in options if o not in taken), "")
        taken.add(wanted[i])
    assert got == wanted
    inst = spark.createDataFrame([("University of Foo", ["UF"], ["Foo Uni"], "GB")], "n string, a array<string>, b array<string>, c string")
    assert inst.select(slugs.institution_candidates(*map(F.col, "nabc"))).first()[0] == ["uf", "foo", "foo-uni", "university-of-foo", "university-of-foo-gb"]
    source = spark.createDataFrame([("The Journal", ["Longer Title", "TJ"], "T. J.")], "n string, a array<string>, b string")
    assert source.select(slugs.source_candidates(*map(F.col, "nab"))).first()[0] == ["tj", "t-j", "longer-title", "the-journal"]
    named = slugs.distinct_names(spark.createDataFrame([(1, "X", "FR", "Paris"), (2, "X", "FR", "Lyon"), (3, "X", "DE", ""), (4, "Y", "", "")], "id int, name string, country string, city string"))
    assert {r.id: r.name for r in named.collect()} == {1: "X (Paris)", 2: "X (Lyon)", 3: "X (DE)", 4: "Y"}


SIX = ["abc", "xyz", "man woo", "axa", "mewixalion", "bumble rumble"]
SEARCHES = [
    (SIX, {"": [0, 1, 2, 3, 4, 5], "q": [], "c": []}, {"a": 0, "x": 1, "ma": 2, "w": 2, "ax": 3, "mewix": 4, "y": 1, "an": 2, "xa": 3, "ion": 4, "wix": 4, "ix": 4}),
    (["aba aba aba", "xxx", "zzz"], {"ab": [0]}, {}),
    (["abas abazz abaxy", "tabaxi", "zzz"], {"ab": [0, 1]}, {}),
    (["aba cdx", "aba", "cdx", "crum brabn", "udx crtasba"], {"ab cd": [0], "ru ra": [3], "dx ba": [0, 4]}, {}),
    (["Hiroyasa Hidaka", "Manuel Hidalgo", "Hisao Hidaka"], {}, {"hidalgo": 1}),
    (["China", "Chile", "Chad"], {}, {"ch": 0}),
    (["Wes"] * 30 + ["West"], {}, {"west": 30}),
    (["MIT", "MITb", "MITc", "MIT Lincoln Laboratory", "GlaxoSmithKline"] + ["MITc"] * 4, {}, {"mit linc": 3}),
]


@pytest.mark.parametrize("case", range(len(SEARCHES)))
def test_search_vectors(spark, case):
    names, exact, first = SEARCHES[case]
    index = search.build_index(spark.createDataFrame(list(enumerate(names)), "rank long, name string")).cache()
    for q, wanted in exact.items():
        assert [r.rank for r in search.search(index, q).collect()] == wanted, q
    for q, wanted in first.items():
        assert search.search(index, q).first().rank == wanted, q
    if names is SIX:
        assert [r.rank for r in search.search(index, "a").collect()][1] == 3 and len(search.search(index, "x").collect()) == 3
    index.unpersist()


def test_ranks_pages_and_sets(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([5, 9, 9, 1, 5])], "id long, citations long")
    ranked = ranking.ranked(rows, blocks=3)
    assert [r.id for r in ranked.orderBy("rank").collect()] == [1, 2, 0, 4, 3]
    assert sorted(r.rank for r in ranking.page(ranked, 3, 9).collect()) == [3, 4] and [r.rank for r in ranking.page(ranked, 99, 0).collect()] == [4]
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(2,), (3,), (4,)], "id int")
    assert [tuple(r) for r in ranking.append_missing(a, b).orderBy("source", "id").collect()] == [(1, 0), (2, 0), (3, 0), (4, 1)]
    assert {r.id: r.side for r in ranking.merge_sides(a, b).collect()} == {1: "left", 2: "both", 3: "both", 4: "right"}
    assert ranking.union_ids(a, b).count() == 4 and ranking.difference_ids(a, b).first().id == 1
    assert [r.id for r in ranking.sample(a, 2, 1).collect()] == [r.id for r in ranking.sample(a, 2, 1).collect()]


def test_every_tree_is_registered():
    assert {k: len(v) for k, v in trees.TREES.items()} == {"authors": 9, "institutions": 9, "countries": 3, "sources": 3, "subfields": 2}
    for s in trees.specs():
        g = trees.GENERATORS[s["generator"]]
        assert len(s["denominators"]) == len(s["levels"]) == len(trees.level_names(g))


def raw_records(folder):
    work = lambda i, year=2015, refs=(), source=1, authors=(1, 2), inst=((1,), (2,)), topics=(("T1", 0.9),), kind="article", retracted=False: {
        "id": f"https://host/W{i}", "doi": None, "display_name": f"Work {i}", "publication_year": year, "type": kind, "is_retracted": retracted,
        "referenced_works": [f"https://host/W{r}" for r in refs], "topics": [{"id": f"https://host/{t}", "score": s} for t, s in topics],
        "locations": [{"source": {"id": f"https://host/S{source}"}}, {"source": None}],
        "authorships": [{"author": {"id": f"https://host/A{a}"} if a else {"id": None}, "institutions": [{"id": f"https://host/I{x}"} for x in ii]} for a, ii in zip(authors, inst)],
    }
    works = [work(1), work(2, 2016, refs=(1,), authors=(1, None), inst=((1, 2), ())), work(3, 2018, refs=(1, 2), source=2, authors=(3,), inst=((3,),), topics=(("T2", 0.9), ("T1", 0.7))),
             work(4, 1950, refs=(1,)), work(5, None, refs=(1,)), work(6, refs=(1,), retracted=True), work(7, refs=(2, 3), kind="dataset"), work(8, 2020, refs=(3, 2, 1), authors=range(1, 22), inst=((1,),) * 21), work(9, 2021, refs=(1, 2, 8, 3))]
    tables = {
        "works": works,
        "authors": [{"id": f"https://host/A{a}", "display_name": f"Author {a}", "works_count": 10, "cited_by_count": 500} for a in range(1, 22)],
        "institutions": [{"id": f"https://host/I{i}", "display_name": "Same" if i < 3 else "Other", "country_code": c, "geo": {"city": f"C{i}", "country_code": c, "country": c}, "display_name_acronyms": ["S"], "unread": 1} for i, c in ((1, "FR"), (2, "FR"), (3, "DE"))],
        "topics": [{"id": f"https://host/T{t}", "display_name": f"Topic {t}", "subfield": {"id": f"https://host/subfields/{t}0"}, "field": {"id": "https://host/fields/1"}, "domain": {"id": "https://host/domains/1"}} for t in (1, 2)],
    }
    for name, rows in tables.items():
        (folder / name).mkdir()
        (folder / name / "part.json").write_text("\n".join(map(json.dumps, rows)))
    return tables


def test_build_from_records_to_trees(spark, tmp_path):
    raw_records(tmp_path)
    read = lambda e: records.read_records(spark, str(tmp_path / e), e)
    t = records.split_works(read("works"))
    t |= {e: records.entity_rows(read(e), e) for e in ("authors", "institutions", "topics")}
    t["source_quartiles"] = spark.createDataFrame([(2015, 1, 2), (2018, 2, 1)], "publication_year int, id long, best_q int")
    config = Config(min_papers_source=1, min_papers_institution=1)
    t = build.write_tables(t, str(tmp_path / "tables"))
    kept = build.write_tables(build.filter_tables(t, config), str(tmp_path / "kept"))
    ids = lambda k: sorted(r.id for r in kept[k].collect())
    assert ids("works") == [1, 2, 3] and ids("sources") == [1, 2] and ids("authors") == [1, 2, 3]
    planned = build.build_graph(t, kept, config)
    build.write_graph(planned, str(tmp_path / "graph"))
    graph = build.read_graph(spark, str(tmp_path / "graph"), planned)
    assert sorted(map(tuple, graph.citing.collect())) == [(1, 2), (1, 3), (2, 3)]
    root = nodes(trees.tree(graph, "authors", 1, 1), ["k1", "k2", "k3"])
    assert root[()] == (2, 3, 1, 2) and root["DE", 20, 2] == (2, 2, 1, 1) and root["FR",] == (1, 1, 1, 1)
    partners = nodes(trees.tree(graph, "institutions", 1, 6), ["k1", "k2", "k3"])
    assert set(partners) == {(), ("FR",), ("FR", 10), ("FR", 10, 2)}
    for kind, entity in (("authors", 1), ("institutions", 1), ("countries", "FR"), ("sources", 1), ("subfields", 10)):
        for tid in range(len(trees.TREES[kind])):
            assert {"depth", "k1", "top_source"} <= set(trees.tree(graph, kind, entity, tid).columns)
        assert 1 <= trees.pruned_tree(graph, kind, entity).count() <= trees.tree(graph, kind, entity).count()
    stat = build.entity_statistics(graph, config)["authors"].filter("entity = 1").first()
    assert (stat.papers, stat.citations, sum(stat.papers_yearly), stat.citations_yearly[2018 - 2015]) == (2, 3, 2, 2)
    related = {kind: {(r.entity, r.inst): r.papers for r in rows.collect()} for kind, rows in build.entity_relations(graph, config).items()}
    links = lambda name: [r for r in graph.tables["r", name].collect() if None not in r]
    assert set(related["authors"]) == {(r.author, r.inst) for r in links("author_inst")}
    assert set(related["countries"]) == {(r.country, r.inst) for r in links("country_inst")}
    assert len(related["institutions"]) > 0 and all(related["institutions"][i, j] == related["institutions"][j, i] for i, j in related["institutions"])


def test_service(spark):
    rows = spark.createDataFrame([(i, f"Name {w}", "", f"name-{w}", p, c) for i, (w, p, c) in enumerate([("alpha", 5, 50), ("beta", 9, 90), ("gamma", 3, 10)], 1)], "id long, name string, extension string, slug string, papers long, citations long")
    edges = spark.createDataFrame([(1, 2)], "ref long, cit long")
    service = api.Service({"authors": ranking.ranked(rows, blocks=2)}, trees.Graph(edges, edges, {}, {}))
    assert [r.slug for r in service.names("authors", "name").collect()] == ["name-beta", "name-alpha", "name-gamma"]
    assert [r.rank for r in service.slice("authors", 1, 3).collect()] == [1, 2]
    assert service.slug_of("authors", 3).first().slug == "name-gamma" and service.counts().first().n == 3
    view = service.view("authors", "name-alpha", 2)
    assert view["entity"].first().id == 1 and view["similar"].count() == 2
    with pytest.raises(KeyError):
        service.view("authors", "none")
    assert len(service.specs()) == 26 and service.tops("authors", (1, 2)).count() == 2


def test_strict_reading(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"id": "W1"}\n{"id": broken\n')
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path), "fields").collect()
    assert records.read_records(spark, str(tmp_path), "fields", strict=False).count() == 1
