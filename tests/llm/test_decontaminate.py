import random
import re

import pytest

from lattica.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def naive(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(name))
    return len(w), hit, sorted(found)


@pytest.mark.parametrize("max_words", [200_000, 40])
def test_hits_match_brute_force(spark, max_words):
    rng = random.Random(9)
    vocab = ["Alpha", "beta,", "é", "the", "x1", "b-c"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, make(rng.randrange(0, 14))) for i in range(14)] + [(50, None), (51, "the the the the"), (52, items0 := make(12)), (53, items0), (None, make(6))]
    texts = [make(rng.randrange(0, 60)) for _ in range(60)] + [items0.upper(), "é", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    for window in (5, 10):
        rows = decontaminate.scan(docs, bench, window, max_words=max_words)
        rows = rows.withColumn("n_hit", decontaminate.hit_words(rows.spans)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            n, hit, found = naive(texts[r.id], [i for i in items if i[0] is not None], window)
            assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, len(hit), found)
            covered = {k for s in r.spans for k in range(s.start, s.end)}
            assert covered == hit


def test_removal(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    filler = " ".join(f"f{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{filler}. {passage.upper()}! {filler}", 0, "x"), (2, passage, 0, "x"), (3, filler, 7, "x"), (4, None, None, "x"), (5, f"{filler} w0 w1 w2 {passage} w3 w4 w5 w6 w7 w8 w9 w10 {filler}", 0, "x")], "doc_id long, text string, n_chars long, items string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = decontaminate.remove(docs, bench)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and sorted(rows) == [1, 3, 4, 5]
    assert rows[1].text == f"{filler}. ! {filler}" and rows[1].n_chars == len(rows[1].text)
    assert rows[3].text == filler and rows[3].n_chars == 7 and rows[4].text is None
    # cutting the passage brings w0 w1 w2 and w3... together, which is cut as well
    assert naive(rows[5].text, [(1, passage)], 10)[1] == set()


def test_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the same text stands here"), (2, "one")], "item_id long, text string")
    rows = decontaminate.scan(odd_docs, bench).collect()
    assert sorted(len(r.spans) for r in rows) == [0] * 6 + [1] * 4
    empty = bench.limit(0)
    assert decontaminate.scan(odd_docs, empty).filter("size(spans) > 0").count() == 0
    assert decontaminate.scan(no_docs, bench).count() == 0 and decontaminate.remove(odd_docs, empty).count() == 10


def cut_by_hand(text, items, window=10, most=0.5):
    """remove() by brute force; None if the document goes."""
    while text:
        n, hit, _ = naive(text, items, window)
        if not hit:
            return text
        if len(hit) > most * n:
            return None
        at, out, done = [m.span() for m in WORD.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))], "", 0
        for k in sorted(hit):
            out += text[done : at[k][0]] if k - 1 not in hit else ""
            done = at[k][1]
        text = out + text[done:]
    return text


@pytest.mark.parametrize("max_words", [200_000, 40])
def test_removal_does_not_depend_on_the_size_of_automata(spark, max_words):
    rng = random.Random(3)
    run = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    items = [(i, run("abcdefgh"[i], 15)) for i in range(8)] + [(8, "four short words here"), (9, run("h", 15) + " tail")]
    a, b, c, other = items[0][1], items[1][1], items[2][1], run("o", 30)
    texts = [f"{a} {run('p', 20)} {b}", f"{other} {a} {other} {b}", f"{other} a0 a1 a2 a3 a4 {b} a5 a6 a7 a8 a9 a10 {other}", f"{other} b0 b1 b2 b3 b4 {a} b5 b6 b7 b8 b9 b10 {other}"]
    texts += [f"{other} four short {c} words here {other}", f"{other}, Four short words here! {other}", other, None, "", c, f"{other} {a} {b}"]
    texts += [" ".join(w for _ in range(6) for w in (rng.choice([a, b, c, other, other, "four short words", "here"]).split()[: rng.randrange(1, 30)])) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts + texts[:2])], "doc_id int, text string, n_chars int, key string")
    out = decontaminate.remove(docs, spark.createDataFrame(items, "item_id int, text string"), max_words=max_words)
    want = {i: cut_by_hand(t, items) for i, t in enumerate(texts + texts[:2])}
    assert want[0] is None and want[5] == f"{other}, ! {other}"
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, t in want.items() if t is not None or i == 7}
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


@pytest.mark.parametrize("max_words", [200_000, 12])
def test_removal_beside_columns_of_any_name(spark, max_words):
    passage = " ".join(f"b{k}" for k in range(12))
    docs = spark.createDataFrame([(1, "a " * 40 + passage, 1, "x", True, 9), (2, passage, 2, "y", False, 9), (3, None, 3, "z", None, 9)], "doc_id long, text string, text_key int, cut_text string, hit boolean, n_chars long")
    items = spark.createDataFrame([(1, passage), (2, "other words " * 6)], "item_id long, text string")
    out = decontaminate.remove(docs, items, max_words=max_words)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.text_key, r.cut_text, r.hit) for r in out.collect()) == [(1, "a " * 40, 1, "x", True), (3, None, 3, "z", None)]
