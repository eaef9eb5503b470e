import hashlib
import math
import re
from zlib import crc32

import pytest

from lattica.llm import target_sampling


def brute(docs, target, least=1, most=1, buckets=97, percent=50, least_words=2, seed=2024):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    grams = lambda ws: [crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(ws) - n + 1)]
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in grams(find(text)):
            s[b] += 1
    for text in target:
        for b in grams(find(text)):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        ws = find(text)
        bs = grams(ws)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(ws), len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    return rows, eligible[: len(eligible) * percent // 100]


@pytest.mark.parametrize("n", [(1, 1), (1, 3), (2, 2)])
def test_equals_brute_force_on_odd_rows(spark, odd_docs, n):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(50, "Ünïcode ÄÖ words-and_more 12,000"), (51, "the a b the"), (52, "THE A B THE")]
    frame = odd_docs.select("doc_id", "text", "id", "tile").unionByName(spark.createDataFrame([(*d, 0, 0) for d in docs[-3:]], "doc_id long, text string, id int, tile int"))
    target = ["the same words w1 w2 w3", None, "", "a b the"]
    goal = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    got = target_sampling.resample(frame, goal, n=n, buckets=97, percent=50, least_words=2).collect()
    rows, drawn = brute(docs, target, *n)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(rows, key=key)
    assert [r["id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [r[0] for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_blocks_are_cut_by_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * (i % 5)) for i in range(40)], "id long, text string").selectExpr("id", "cast(text as binary) as text").coalesce(1)
    monkeypatch.setattr(target_sampling, "BLOCK_DOCUMENTS", 7)
    blocks = target_sampling.bucket_streams(docs, (1, 1), 16).collect()
    assert sorted(i for b in blocks for i in b["ids"]) == list(range(40))
    assert all(b["offsets"][-1] * 2 == len(b["stream"]) and len(b["offsets"]) == len(b["ids"]) + 1 for b in blocks)


def test_empty_tables(spark, no_docs, odd_docs):
    goal = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert target_sampling.resample(no_docs, goal).collect() == []
    got = target_sampling.resample(odd_docs, goal.limit(0), percent=100, least_words=0).collect()
    assert len(got) == odd_docs.count() and all(r["rank"] for r in got)


def test_sampled_documents_and_parameters(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 5, "x") for i in range(20)], "doc_id long, text string, rank string")
    out = target_sampling.sampled(docs, docs, percent=25, least_words=5)
    assert out.columns == docs.columns and out.count() == 5
    with pytest.raises(ValueError):
        target_sampling.bucket_streams(docs.selectExpr("doc_id as id", "cast(text as binary) as text"), (1, 1), 70_000)
    with pytest.raises(ValueError):
        target_sampling.bucket_streams(docs.selectExpr("doc_id as id", "cast(text as binary) as text"), (2, 1), 100)
