"""A registered query runs merge_sides over whole tables, with every side."""

import os

import duckdb
import pytest

from lattica.queries import QUERIES

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_tables_and_all_sides(spark):
    got = QUERIES["merge_sides_whole"](spark, SF).groupBy("side").count().collect()
    days = f"select cast(o_orderdate as date) as k from read_parquet('{SF}/orders.parquet') union select cast(l_shipdate as date) from read_parquet('{SF}/lineitem.parquet')"
    assert {r.side for r in got} == {"left", "right", "both"}
    assert sum(r["count"] for r in got) == duckdb.sql(f"select count(*) from ({days})").fetchall()[0][0]
