import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lattica.llm import exact_dedup


def brute(docs):
    groups = {}
    for i, text in docs:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), i is None, i or 0))
    out = []
    for norm, rows in groups.items():
        best = min(rows)
        for k, r in enumerate(sorted(rows)):
            one, keep = (None if x[1] else x[2] for x in (r, best))
            out.append((one, keep, len(rows), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


DOCS = [
    (9, "a b c"), (4, "abc"), (7, "a\tb\x0bc  "), (5, "abc\n\n\n\n"), (3, "a bc"), (2, "ABC"), (1, None), (8, ""), (6, " \n "), (None, "abc"), (None, "zz"), (None, "zz"),
    (20, "é\U0001f600"), (21, "é \U0001f600"), (22, "é\U0001f600"), (30, "same"), (30, "same"), (30, "sa me"), (40, "once"),
]


@pytest.mark.parametrize("weak", [None, "one", "two"])
def test_equals_brute_force(spark, odd_docs, weak):
    """Also with hashes of few bits, where all groups collide."""
    docs = DOCS + [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    frame = odd_docs.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(*d, 0) for d in DOCS], "doc_id long, text string, row int"))
    hashes = {None: exact_dedup.md5_128, "one": lambda c: F.lit(b"x"), "two": lambda c: (F.length(c) % 3).cast("string").cast("binary")}
    got = exact_dedup.duplicates(frame, content_hash=hashes[weak]).select("id", "keep_id", "group_size", "kept", "text_sha256")
    assert ordered(got.collect()) == ordered(brute(docs))


def test_large_groups_are_met_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 10)
    docs = [(i, "hot text" if i % 3 else f"pair {i // 6}") for i in range(300)]
    got = exact_dedup.duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert ordered(got.collect()) == ordered(brute(docs))


def test_many_hashes_are_matched_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", 0)
    got = exact_dedup.duplicates(spark.createDataFrame(DOCS, "doc_id long, text string"), content_hash=lambda c: F.substring(c.cast("binary"), 1, 1))
    assert ordered(got.collect()) == ordered(brute(DOCS))


def test_keep_one_returns_documents(spark, odd_docs, no_docs):
    out = exact_dedup.keep_one(odd_docs)
    assert out.schema.names == odd_docs.schema.names
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    want = [(r[0], r[4]) for r in brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()]) if r[3]]
    assert sorted((i, hashlib.sha256(re.sub(r"\s", "", t or "").encode()).hexdigest()) for i, t in kept if i is not None) == sorted(w for w in want if w[0] is not None)
    assert exact_dedup.keep_one(no_docs).collect() == [] and exact_dedup.duplicates(no_docs).collect() == []


def test_no_python_in_the_plan(spark, odd_docs):
    plan = exact_dedup.duplicates(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
