"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Document words stream through the automaton, which keeps the longest match ending at each word; matches of a
window's length or more are hits. Only stretches whose neighbouring words also stand side by side in some item
can hold a match, so numpy picks those stretches out and the automaton sees nothing else.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import free_names
from ._common import Scratch, text_bytes

#: bytes of words stay (A-Z in lower case), all others become spaces
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BITS = 22
SEGMENT = 50_000  # words; longer items are fed in segments that overlap by a window


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class ItemAutomaton:
    """Generalised suffix automaton over the words of (item, words) pairs; ``item`` is any number."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = 10):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for item, ws in items if ws]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.marks: dict[int, set[int]] = {}  # state of a window -> items
        self.short: dict[int, list[tuple[int, int]]] = {}  # state -> (length, item) of items below a window
        pairs = set()
        for item, seq in coded:
            pairs.update(zip(seq, seq[1:]))
            state = 0
            for i, w in enumerate(seq):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.marks.setdefault(self._suffix(state, window), set()).add(item)
            if len(seq) < window:
                self.short.setdefault(self._suffix(state, len(seq)), []).append((len(seq), item))
        self.least = min([window, *(len(seq) for _, seq in coded)])
        self.pair_map = np.zeros(1 << _BITS, bool)
        if pairs:
            a, b = np.array(list(pairs), np.int64).T
            self.pair_map[self._pair_code(a, b)] = True

    @staticmethod
    def _pair_code(a, b):
        return (a * 1_000_003 + b) & ((1 << _BITS) - 1)

    def _suffix(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _state(self, length: int, link: int, out: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(out)
        return len(self.length) - 1

    def _split(self, state: int, w: int, target: int) -> int:
        """A copy of ``target`` that holds only its suffixes up to one word more than ``state``."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(w) == target:
            self.next[state][w] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and w not in self.next[state]:
            self.next[state][w] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][w]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, w, target)
        return new

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal stretches of words (ids, negative if in no item) that may hold a match."""
        if self.least > 1:
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            at = np.flatnonzero(ok)
            ok[at] = self.pair_map[self._pair_code(ids[at], ids[at + 1])]
        else:
            ok = ids >= 0
        edge = np.diff(np.concatenate([[0], ok.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        extra = 1 if self.least > 1 else 0
        long = end - start + extra >= self.least
        return list(zip(start[long].tolist(), (end[long] + extra).tolist()))

    def hits(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """(merged spans, items, longest match) of a stretch of word ids."""
        spans: list[list[int]] = []
        found: set[int] = set()
        state = matched = longest = 0
        for i, w in enumerate(seq):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            longest = max(longest, matched)
            reach = 0
            if matched >= self.window:
                reach = matched
                found |= self.marks[self._suffix(state, self.window)]
            if self.short:
                node = state
                while node > 0:
                    for n, item in self.short.get(node, ()):
                        if n <= matched:
                            reach = max(reach, n)
                            found.add(item)
                    node = self.link[node]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [(a, b) for a, b in spans], found, longest

    def scan(self, texts: list[bytes]):
        """(number of words, spans in words, items, longest match) of each text."""
        get = {**self.vocab, b"\x00": -2}.get
        tokens = b" \x00 ".join(t.translate(_WORDS) for t in texts).split()
        ids = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
        cut = np.concatenate([[-1], np.flatnonzero(ids == -2), [len(ids)]])
        out = [[int(n), [], set(), 0] for n in np.diff(cut) - 1]
        for start, end in self.stretches(ids):
            spans, found, longest = self.hits(ids[start:end].tolist())
            if spans:
                row = int(np.searchsorted(cut, start, side="right")) - 1
                base = start - int(cut[row]) - 1
                out[row][1] += [(a + base, b + base) for a, b in spans]
                out[row][2] |= found
                out[row][3] = max(out[row][3], longest)
        return out


def item_words(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text", max_words: int = 200_000) -> tuple[DataFrame, int]:
    """(name, words) of the items, ids as strings, and the number of automata of about ``max_words`` words that they need.

    Items longer than 50,000 words go in as overlapping segments.
    """

    def cut(batches):
        for batch in batches:
            names, parts = [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                ws = words(text)
                for at in range(0, max(1, len(ws) - window + 1), SEGMENT):
                    names.append(name)
                    parts.append(b" ".join(ws[at : at + SEGMENT + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], ["name", "words"])

    rows = items.select(F.col(id_col).cast("string").alias("name"), text_bytes(text_col).alias("text")).filter("name is not null").mapInArrow(cut, "name string, words binary")
    rows = Scratch(items.sparkSession, "items").put(rows.filter("octet_length(words) > 0"), "words")
    total = rows.agg(F.coalesce(F.sum(F.size(F.split(F.col("words").cast("string"), " "))), F.lit(0))).first()[0]
    return rows, max(1, -(-total // max_words))


def automata_of(rows: DataFrame, shards: int, window: int = 10):
    """(names, automaton) pairs of ``item_words``, built one after the other.

    Items are dealt to automata by hash, so no more than one automaton's words are on the driver at a time. An automaton's
    numbers refer to places in ``names``.
    """
    for k in range(shards):
        part = rows.filter(F.pmod(F.xxhash64("words"), F.lit(shards)) == k).distinct().collect()
        names = sorted({r["name"] for r in part})
        place = {n: i for i, n in enumerate(names)}
        yield names, ItemAutomaton([(place[r["name"]], bytes(r["words"]).split()) for r in part], window)


def build_automata(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text", max_words: int = 200_000):
    """(names, automaton) pairs, each over about ``max_words`` item words, built one after the other."""
    yield from automata_of(*item_words(items, window, id_col, text_col, max_words), window)


_SCAN = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, longest bigint"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pieces(batch, size: int = 2 << 20):
    """Slices of a batch with about ``size`` bytes of text."""
    at, texts, held = 0, [], 0
    for i, text in enumerate(batch.column("text")):
        texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
        held += len(texts[-1])
        if held >= size:
            yield at, texts
            at, texts, held = i + 1, [], 0
    if texts:
        yield at, texts


def scan(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_words: int = 200_000) -> DataFrame:
    """(id, n_words, spans, items, longest): word spans of each document inside any occurring window, and the items hit.

    One row per input row. A window is ``window`` consecutive words of an item, or all of a shorter item. Null texts have no words; items without
    words or ids match nothing; items of equal text are all named. An empty table gives no rows, an empty benchmark no hits.
    A benchmark over ``max_words`` is matched by several automata in turn, each in a pass of its own.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))

    def matched(names, automaton):
        shared = spark.sparkContext.broadcast((names, automaton))  # at most max_words words

        def run(batches):
            names, automaton = shared.value
            for batch in batches:
                for at, texts in _pieces(batch):
                    rows = automaton.scan(texts)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("id").slice(at, len(texts)), pa.array(texts, pa.binary()) if keep_text else pa.nulls(len(texts), pa.binary()),
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], _SPANS),
                        pa.array([sorted(names[i] for i in r[2]) for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.int64()),
                    ], ["id", "text", "n_words", "spans", "items", "longest"])

        return source.mapInArrow(run, f"id {id_type}, text binary, {_SCAN}")

    automata = build_automata(items, window, item_col, item_text_col, max_words)
    first = next(automata)
    second = next(automata, None)
    keep_text = second is not None
    if not keep_text:
        return matched(*first).drop("text")
    scratch = Scratch(spark, "decontaminate")
    keyed = lambda df: df.withColumn("key", F.sha2("text", 256)).drop("text")
    found = keyed(matched(*first)).filter("size(spans) > 0")
    found = scratch.put(found, "hits0")
    k = 0
    while second is not None:
        k += 1
        found = found.unionByName(scratch.put(keyed(matched(*second)).filter("size(spans) > 0"), f"hits{k}"))
        second = next(automata, None)
    empty = ItemAutomaton([], window)
    merged = found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("i"), F.max("longest").alias("l"))
    every = keyed(matched([], empty)).select("id", "key", "n_words")
    none_s, none_i = F.array().cast("array<struct<start:bigint,end:bigint>>"), F.array().cast("array<string>")
    return every.join(merged, "key", "left").select("id", "n_words", F.coalesce("s", none_s).alias("spans"), F.coalesce("i", none_i).alias("items"), F.coalesce("l", F.lit(0)).alias("longest"))


def hit_words(spans) -> F.Column:
    """Number of words in any of the spans, which may overlap."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))

    def step(acc, s):
        start = F.greatest(s["start"], acc["upto"])
        return F.struct((acc["n"] + F.greatest(s["end"] - start, F.lit(0).cast("bigint"))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the stretches from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for start, end in sorted(spans):
        out.append(text[done : max(done, at[start][0])])
        done = max(done, at[end - 1][1])
    return "".join(out) + text[done:]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without_hits(text: str, n_words: int, spans: list[tuple[int, int]], most_coverage: float) -> str | None:
    """The text without its hit spans; None if they hold more than ``most_coverage`` of its words."""
    spans = united(spans)
    return None if sum(b - a for a, b in spans) > most_coverage * n_words else without_spans(text, spans)


def remove(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.5, text_col: str = "text", length_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", max_words: int = 200_000) -> DataFrame:
    """The documents without benchmark passages, in the columns they came with.

    A passage is a window of an item or all of a shorter item, as for ``scan``. Documents with more than ``most_coverage`` of their words in
    passages go. What a removal brings together is scanned again until nothing is hit. ``length_col``, if there, is set to
    the new number of characters. Rows without hits pass unchanged, null texts included. The result does not depend on ``max_words``: of a
    large benchmark the hits of all automata are united before a document is judged and cut.
    """
    rows, shards = item_words(items, window, item_col, item_text_col, max_words)
    if shards > 1:
        return _remove_by_many(docs, rows, shards, window, most_coverage, text_col, length_col)
    shared = docs.sparkSession.sparkContext.broadcast(next(automata_of(rows, 1, window))[1])  # at most max_words words
    place = docs.columns.index(text_col)
    lengths = docs.columns.index(length_col) if length_col in docs.columns else None

    def clean(automaton, text: str, row) -> str | None:
        while text is not None and row[1]:
            text = without_hits(text, row[0], row[1], most_coverage)
            row = automaton.scan([(text or "").encode()])[0]
        return text

    def run(batches):
        automaton = shared.value
        for batch in batches:
            texts = batch.column(place)
            view = pa.RecordBatch.from_arrays([texts.cast(pa.binary())], ["text"])
            keep, change = [], {}
            for at, part in _pieces(view):
                for i, (raw, row) in enumerate(zip(part, automaton.scan(part)), at):
                    if row[1]:
                        text = clean(automaton, raw.decode(), row)
                        if text is None:
                            continue
                        change[i] = text
                    keep.append(i)
            if change:
                columns = list(batch.columns)
                columns[place] = pa.array([change.get(i, v) for i, v in enumerate(texts.to_pylist())], texts.type)
                if lengths is not None:
                    old = columns[lengths]
                    columns[lengths] = pa.array([len(change[i]) if i in change else v for i, v in enumerate(old.to_pylist())], old.type)
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def _remove_by_many(docs: DataFrame, rows: DataFrame, shards: int, window: int, most_coverage: float, text_col: str, length_col: str | None) -> DataFrame:
    """``remove`` by several automata in turn, each in a pass of its own, and all of them again over the texts that were cut."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")

    def matched(source, automaton):
        shared = spark.sparkContext.broadcast(automaton)  # at most max_words words

        def run(batches):
            automaton = shared.value
            for batch in batches:
                for at, texts in _pieces(batch):
                    hit = [(i, t, r) for i, (t, r) in enumerate(zip(texts, automaton.scan(texts)), at) if r[1]]
                    keys = batch.column("key").take(pa.array([i for i, _, _ in hit], pa.int64()))
                    spans = pa.array([[{"start": a, "end": b} for a, b in r[1]] for _, _, r in hit], _SPANS)
                    yield pa.RecordBatch.from_arrays([keys, pa.array([t for _, t, _ in hit], pa.binary()), pa.array([r[0] for _, _, r in hit], pa.int64()), spans], ["key", "text", "n_words", "spans"])

        return source.mapInArrow(run, "key string, text binary, n_words bigint, spans array<struct<start:bigint,end:bigint>>")

    def cut(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("text", "n_words", "spans"))
            out = [without_hits(t.decode(), n, [(s["start"], s["end"]) for s in spans], most_coverage) for t, n, spans in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([None if t is None else t.encode() for t in out], pa.binary())], ["key", "text"])

    source = docs.select(text_bytes(text_col).alias("text")).select(F.sha2("text", 256).alias("key"), "text")
    changed, turn = None, 0
    while True:
        hits = None
        for k, (_, automaton) in enumerate(automata_of(rows, shards, window)):
            found = scratch.put(matched(source, automaton).dropDuplicates(["key"]), f"hits{turn}_{k}")
            hits = found if hits is None else hits.unionByName(found)
        whole = hits.groupBy("key").agg(F.first("text").alias("text"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
        done = scratch.put(whole.mapInArrow(cut, "key string, text binary"), f"cut{turn}")
        if changed is not None and done.isEmpty():
            break
        changed = done if changed is None else scratch.put(changed.join(done, "key", "left_anti").unionByName(done), f"changed{turn}")
        source, turn = done.filter("text is not null"), turn + 1
    key, cut_text, hit = free_names(docs, "text_key", "cut_text", "hit")
    changed = changed.select(F.col("key").alias(key), F.col("text").cast("string").alias(cut_text), F.lit(True).alias(hit))
    out = docs.withColumn(key, F.sha2(text_bytes(text_col), 256)).join(changed, key, "left").filter(F.col(hit).isNull() | F.col(cut_text).isNotNull())
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns[text_col] = F.coalesce(cut_text, columns[text_col])
    if length_col in docs.columns:
        columns[length_col] = F.when(F.col(cut_text).isNull(), columns[length_col]).otherwise(F.length(cut_text).cast(docs.schema[length_col].dataType))
    return out.select(*(v.alias(c) for c, v in columns.items()))
