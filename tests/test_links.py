"""Joins of links whose keys repeat."""

import time

from lattica.operators import links


def test_repeated_facts_meet_their_sources_once(spark):
    """60,000 sources of one ISSN, whose two areas are listed 60,000 times: 120,000 pairs, not 3.6 billion."""
    pairs = spark.range(60_000).selectExpr("id", "'a' as issn")
    facts = spark.range(60_000).selectExpr("'a' as issn", "cast(id % 2 as string) as area")
    began = time.time()
    assert links.issn_join(pairs, facts).count() == 120_000
    assert time.time() - began < 30
