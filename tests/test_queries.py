"""Every registered query of the graph operators against its SQL in DuckDB, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from lattica.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
#: of the catalogue's trees, one a root here; the others differ in their joined tables alone
TREES = {"tree_authors_5", "tree_institutions_6", "tree_countries_0", "tree_sources_1", "tree_subfields_0"}
EVERY = os.environ.get("QUERY_ALL")
NAMES = [n for n in sorted(ORACLE_SQL) if EVERY or n in TREES or not n[-1].isdigit() or not n.startswith("tree_")]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
