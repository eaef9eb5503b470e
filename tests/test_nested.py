"""Nested records as tables: all layouts from one walk, and values out of raw JSON text."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica import schema
from lattica.sources import records

COUNTS = [{"year": 2020, "works_count": 3, "cited_by_count": 4, "oa_works_count": None}, None, {"year": 2021, "works_count": 1, "cited_by_count": 0, "oa_works_count": 1}]
RECORDS = {
    "works": [
        {"id": "W1", "display_name": "One", "referenced_works": ["W2", None, "W3"], "topics": [{"id": "T1", "score": 0.5}], "locations": [{"source": {"id": "S1"}, "is_oa": True}, {"source": None}],
         "authorships": [{"author": {"id": "A1"}, "institutions": [{"id": "I1"}, {"id": "I2"}]}, {"author": None, "institutions": []}], "biblio": {"volume": "7"}, "open_access": {"is_oa": False}, "ids": {"doi": "d"}},
        {"id": "W2", "referenced_works": None, "topics": [], "authorships": None},
    ],
    "concepts": [{"id": "C1", "level": 2, "ancestors": [{"id": "C0"}, {"id": "C9"}], "related_concepts": [{"id": "C2", "score": 1.5}], "counts_by_year": COUNTS}],
    "institutions": [{"id": "I1", "geo": {"city": "X", "latitude": 1.5}, "associated_institutions": [{"id": "I2", "relationship": "child"}], "display_name_acronyms": ["A", "B"]}],
    "authors": [{"id": "A1", "summary_stats": {"h_index": 3, "2yr_mean_citedness": 0.5}}],
}
CHILDREN = {
    "works": {"ids", "counts_by_year", "topics", "locations", "locations_source", "authorships", "authorships_author", "authorships_institutions", "biblio", "open_access", "referenced_works"},
    "concepts": {"ids", "counts_by_year", "ancestors", "related_concepts"}, "authors": {"ids", "counts_by_year", "summary_stats"}, "fields": {"ids", "counts_by_year"}, "domains": {"ids", "counts_by_year"},
    "institutions": {"ids", "counts_by_year", "geo", "associated_institutions", "display_name_acronyms", "display_name_alternatives"},
    "sources": {"ids", "counts_by_year", "issn", "alternate_titles"}, "publishers": {"ids", "counts_by_year", "country_codes", "parent_publisher"},
    "topics": {"ids", "counts_by_year", "subfield", "field", "domain"}, "subfields": {"ids", "counts_by_year", "field"},
}


@pytest.mark.parametrize("entity", sorted(schema.ENTITIES))
def test_every_layout(spark, tmp_path, entity):
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, RECORDS.get(entity, [{"id": "X1", "counts_by_year": COUNTS}]))))
    tables = records.split_nested(records.read_records(spark, str(tmp_path), entity), entity)
    assert set(tables) == {entity, *(f"{entity}_{c}" for c in CHILDREN[entity])}
    for name, table in tables.items():
        keys = [r.key for r in table.select("key").collect()]
        assert len(set(keys)) == len(keys), name
    if entity not in RECORDS or entity == "concepts":
        counts = tables[f"{entity}_counts_by_year"].orderBy("position").collect()
        assert [(r.parent_key, r.position, r.year, r.works_count) for r in counts] == [(RECORDS.get(entity, [{"id": "X1"}])[0]["id"], 0, 2020, 3), (RECORDS.get(entity, [{"id": "X1"}])[0]["id"], 2, 2021, 1)]


def test_children_of_children_against_sql(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text("\n".join(map(json.dumps, RECORDS["works"])))
    tables = records.split_nested(records.read_records(spark, str(tmp_path), "works"), "works")
    con = duckdb.connect()
    con.execute(f"create view w as select * from read_json('{path}', format = 'newline_delimited')")
    ships = con.execute("select id, i - 1, id || '.authorships.' || (i - 1), a.author.id, a.institutions from (select id, unnest(authorships) as a, generate_subscripts(authorships, 1) as i from w)").fetchall()
    got = tables["works_authorships"].join(tables["works_authorships_author"].select(F.col("parent_key").alias("key"), "id"), "key", "left").collect()
    assert sorted((r.parent_key, r.position, r.key, r.id) for r in got) == sorted(s[:4] for s in ships)
    got = tables["works_authorships_institutions"].collect()
    assert sorted((r.parent_key, r.position, r.id) for r in got) == sorted((s[2], k, i["id"]) for s in ships for k, i in enumerate(s[4] or []))
    want = con.execute("select id, i - 1, v from (select id, unnest(referenced_works) as v, generate_subscripts(referenced_works, 1) as i from w) where v is not null").fetchall()
    assert sorted((r.parent_key, r.position, r.value) for r in tables["works_referenced_works"].collect()) == sorted(want)
    assert [tuple(r) for r in tables["works_biblio"].collect()] == [("W1.biblio", "W1", "7", None, None, None)]
    assert [(r.key, r.id, r.display_name) for r in tables["works"].orderBy("key").collect()] == [("W1", "W1", "One"), ("W2", "W2", None)]


def test_fields_named_like_keys_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "k", [(5, "p")])], "id long, key string, items array<struct<position: int, parent_key: string>>")
    tables = records.split_nested(rows, "r")
    assert tables["r"].columns == ["key", "id", "key_"] and [tuple(r) for r in tables["r_items"].collect()] == [("1.items.0", "1", 0, 5, "p")]
    assert all(t.collect() == [] for t in records.split_nested(rows.limit(0), "r").values())


def test_values_of_json_text(spark):
    text = json.dumps({"authorships": [{"author": {"id": "A1"}, "institutions": [{"id": "I1"}, {"id": 7}]}, {"author": None}, 3, {"institutions": [{}, {"id": "I3"}]}], "n": [1, "2", "x", 2.0], "id": "W1"})
    rows = spark.createDataFrame([(1, text), (2, "{broken"), (3, None), (4, ""), (5, "[]"), (6, "null")], "id long, text string")
    paths = {"$.authorships[*].institutions[*].id": "string", "$.authorships[*].author.id": "string", "$.id": "string", "$.n[*]": "bigint", "$.none[*].id": "string"}
    got = rows.select("id", *[records.json_values(F.col("text"), p, k).alias(str(i)) for i, (p, k) in enumerate(paths.items())]).orderBy("id").collect()
    assert list(got[0][1:]) == [["I1", "7", "I3"], ["A1"], ["W1"], [1, 2, 2], []]
    assert all(list(r[1:]) == [[]] * 5 for r in got[1:])
