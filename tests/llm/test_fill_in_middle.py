import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import fill_in_middle


def brute(docs, seed=7, percent=100, spm_percent=50, marks=("<P>", "<S>", "<M>")):
    p, s, m = marks
    out = []
    for i, text in docs:
        text = text or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        digits = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        if not text or any(x in text for x in marks) or h[2] % 100 >= percent:
            out.append((i, len(lines), "plain", None, None, text))
        elif h[3] % 100 < spm_percent:
            out.append((i, len(lines), "spm", len(pre), len(mid), s + suf + p + pre + m + mid))
        else:
            out.append((i, len(lines), "psm", len(pre), len(mid), p + pre + s + suf + m + mid))
    return out


ODD = [
    "", "\n", "\n\n\n", "one", "one\n", "a\nb", "a\nb\n", "\na", "é\nü\U0001f600\n漢字\n", "x<P>y\nz", "<S>", "a<\nM>b\n<", "<\nP", "<M", "line\r\nother\rsame\n", "  not a line\n\x0b\x0c\n",
]


def same(spark, docs, frame=None, **parameters):
    frame = spark.createDataFrame(docs, "doc_id long, text string") if frame is None else frame
    made = fill_in_middle.transform(frame, **parameters)
    got = made.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(brute(docs, **parameters), key=repr)
    assert sorted((r["id"], r["again"]) for r in got if r["id"] is not None) == sorted((i, t or "") for i, t in docs if i is not None)


def test_equals_brute_force(spark):
    same(spark, [(k * 100 + i, t) for k in range(8) for i, t in enumerate(ODD)] + [(None, "a\nb\nc"), (7, None), (None, None)])


def test_odd_rows(spark, odd_docs, no_docs):
    same(spark, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], odd_docs)
    assert fill_in_middle.transform(no_docs).collect() == []


def test_shares_and_seed(spark):
    same(spark, [(i, f"l{i}\n" * (i % 7)) for i in range(60)], seed=11, percent=40, spm_percent=20)


def test_long_texts_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "SLICE", 50)  # workers of a local session import it anew; what is cut here is the helper below
    offsets = np.array([0, 10, 10, 70, 75, 76, 200])
    assert [tuple(x) for x in fill_in_middle._slices(offsets)] == [(0, 2), (2, 3), (3, 5), (5, 6)]
    same(spark, [(1, "line of a very long text é\n" * 300_000), (2, "x" * 3_000_000), (3, "a\n")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a\né\U0001f600<", max_size=12), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=8))
def test_cuts_of_any_batch(rows):
    data = np.frombuffer("".join(t for t, _, _ in rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t, _, _ in rows])]).astype(np.int64)
    one, other = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    n, first, second, prefix, middle = fill_in_middle.find_cuts(data, offsets, one, other)
    for i, (t, x, y) in enumerate(rows):
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        a, b = sorted((x % (len(lines) + 1), y % (len(lines) + 1)))
        assert n[i] == len(lines)
        assert (prefix[i], middle[i]) == (len("".join(lines[:a])), len("".join(lines[a:b])))
        assert first[i] - offsets[i] == len("".join(lines[:a]).encode()) and second[i] - offsets[i] == len("".join(lines[:b]).encode())


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "S<", "<M>"), ("", "<S>", "<M>")])
def test_sentinels_that_could_blend_with_text(spark, no_docs, marks):
    with pytest.raises(ValueError):
        fill_in_middle.transform(no_docs, sentinels=marks)
