"""Slugs of several candidates against assigning one id after the other, in rounds and in one task."""

import random

import pytest

from lattica.operators import slugs


def brute(rows):
    taken, out = set(), {}
    for i, works, candidates in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[0]), reverse=True):
        forms = [*(candidates or []), *([f"{candidates[-1]}-{c}" for c in slugs.SUFFIXES] if candidates else [])]
        out[i] = next((f for f in forms if f not in taken), "")
        taken.add(out[i])
    return out


def made(rng, n):
    word = lambda: rng.choice("abcde") * rng.choice([1, 1, 2])
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25:
            candidates = ["same", "name"]  # more than there are forms
        elif kind < 0.4:
            candidates = ["name"]
        elif kind < 0.5:
            candidates = [word(), "name-3", "name"]  # natural forms that equal suffixed ones
        elif kind < 0.55:
            candidates = rng.choice([None, [], ["aa-2", "aa"]])
        elif kind < 0.75:
            candidates = [word(), word(), f"own-{i}"]
        else:
            candidates = [word() for _ in range(rng.choice([1, 2, 3]))]
        rows.append((i, rng.choice([None, *range(6)]), candidates))
    return rows


@pytest.mark.parametrize("finish", [0, 20_000])
def test_equals_one_after_the_other(spark, monkeypatch, finish):
    monkeypatch.setattr(slugs, "FINISH_ROWS", finish)
    rows = made(random.Random(finish + 1), 70 if finish < 100 else 900)
    got = slugs.assign_slugs(spark.createDataFrame(rows, "id long, works int, candidates array<string>"))
    assert {r["id"]: r["slug"] for r in got.collect()} == brute(rows)


def test_no_rows(spark):
    assert slugs.assign_slugs(spark.createDataFrame([], "id long, works int, candidates array<string>")).collect() == []
