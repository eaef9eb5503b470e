"""Brown class-based bigram language model: P(word | previous) = P(class | previous class) * P(word | class).

Words get classes by exchange. It starts with the most frequent words, a fixed number, which are moved between classes one at a time
until no move raises the likelihood of their bigrams. Then come rounds over the whole vocabulary: every word, in parallel, moves to
the class that raises the likelihood of all its neighbours most, its own counts removed. In the first round the neighbours of the
start have classes and the start stays; from the second on every word has one, class bigrams are counted
anew over all tokens, and all words may move. Transitions and emissions are counted over the whole corpus afterwards, and the
model is mixed with smoothed word frequencies.

The corpus is encoded once into blocks: rows of some three million tokens, numbered within the block, with the block's own word list in
the order of the words' hashes. Each range of hashes has a home, which numbers the words of its range as they come from the blocks and
keeps their counts and classes. Blocks and homes exchange one packed row a pair: words and counts once, then, round
by round, neighbour counts to the homes and classes back, in the order of the list. No task or driver holds the vocabulary.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, text_bytes
from ._common import packed as _packed
from ._common import unpacked as _unpacked

BLOCK_TOKENS = 3_000_000
HOME_WORDS = 500_000  # list entries a home
END = b""  # the token after each text; no word is empty


def _rows(table):
    """Dictionaries of a batch's or table's values, as Arrow scalars."""
    names = table.column_names if isinstance(table, pa.Table) else table.schema.names
    return (dict(zip(names, row)) for row in zip(*table.columns))


def _words(value) -> list[bytes]:
    return zstandard.decompress(value.as_buffer()).split(b" ")


def encode_blocks(rows: DataFrame) -> DataFrame:
    """(block, ids, lens, train, tokens, end, size, words, counts) from (id, text binary, held_out).

    tokens number the words of the block's texts in ``words``, ``size`` of them in the order of their hashes, each text followed by
    the end token, number ``end``; lens are tokens a text; counts are occurrences in training texts.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["block", "ids", "lens", "train", "tokens", "end", "size", "words", "counts"]

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, lens, train, tokens, held = [], [], [], [], 0
        local = None

        def block():
            flat, sizes, used = np.concatenate(tokens), np.array(lens, np.int32), np.array(train, np.uint8)
            seen = np.bincount(flat[np.repeat(used.view(bool), sizes)], minlength=len(local)).astype(np.int32)
            words = list(local)
            order = np.argsort(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            listed = zstandard.compress(b" ".join([words[i] for i in order.tolist()]), 1)
            values = [part << 24 | number, ids, _packed(sizes), _packed(used), _packed(rank[flat]), int(rank[0]), len(words), listed, _packed(seen[order])]
            kinds = [pa.int64(), pa.list_(kind), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            kind = batch.schema.field("id").type
            batch_ids = batch.column("id").to_pylist()
            out = batch.column("held_out").to_pylist()
            for i, text in enumerate(batch.column("text")):
                if local is None:
                    local, fresh = {END: 0}, count(1)
                words = text.as_py().lower().split()
                words.append(END)
                for w in words:
                    if w not in local:
                        local[w] = next(fresh)
                tokens.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
                ids.append(batch_ids[i]), lens.append(len(words)), train.append(not out[i])
                held += len(words)
                if held >= BLOCK_TOKENS:
                    yield block()
                    number, local = number + 1, None
                    ids, lens, train, tokens, held = [], [], [], [], 0
        if ids:
            yield block()

    schema = f"block bigint, ids array<{id_type}>, lens binary, train binary, tokens binary, end int, size int, words binary, counts binary"
    return rows.mapInArrow(run, schema)


def _training(row) -> np.ndarray:
    """The tokens of the block's training texts, an end token before the first."""
    used = np.repeat(_unpacked(row["train"], np.uint8).view(bool), _unpacked(row["lens"], np.int32))
    return np.concatenate([[row["end"].as_py()], _unpacked(row["tokens"], np.int32)[used]]).astype(np.int64)


def _of_core(words: list[bytes], core: dict[bytes, int]) -> np.ndarray:
    """Each word's place in the core, or -1."""
    return np.fromiter((core.get(w, -1) for w in words), np.int64, len(words))


def word_lists(blocks: DataFrame, homes: int) -> DataFrame:
    """(home, block, words, counts): each block's word list, cut into the ranges of the homes."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                words, seen = _words(row["words"]), _unpacked(row["counts"], np.int32)
                home = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(homes) >> np.uint64(32)
                cut = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), len(words)]
                for a, b in zip(cut, cut[1:]):
                    values = int(home[a]), row["block"].as_py(), zstandard.compress(b" ".join(words[a:b]), 1), _packed(seen[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int64()), pa.array([values[1]], pa.int64()), pa.array(values[2:3], pa.binary()), pa.array(values[3:], pa.binary())], ["home", "block", "words", "counts"])

    return blocks.select("block", "words", "counts").mapInArrow(run, "home bigint, block bigint, words binary, counts binary")


STATE = -1  # the row of a home that stands for no block
HOME = "home bigint, block bigint, ids binary, counts binary, classes binary, top binary, top_ids binary"


def _home_rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in HOME.split(", ")])


def settle(lists: DataFrame, classes: int, core_words: int) -> DataFrame:
    """The homes: a row for each block with its words' numbers in the home, and a row with counts, classes (none yet) and the most frequent words."""

    def run(group: pa.Table) -> pa.Table:
        home, place, ids, counts = group.column("home")[0].as_py(), {}, {}, {}
        for row in sorted(_rows(group), key=lambda r: r["block"].as_py()):
            words = _words(row["words"])
            ids[row["block"].as_py()] = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words))
            counts[row["block"].as_py()] = _unpacked(row["counts"], np.int32)
        total = np.zeros(len(place), np.int64)
        for block, which in ids.items():
            total[which] += counts[block]  # no word twice in a block
        words, most = list(place), np.argsort(-total, kind="stable")
        least = total[most[min(core_words, len(most)) - 1]]
        most = sorted(np.flatnonzero(total >= max(1, least)).tolist(), key=lambda i: (-total[i], words[i]))[:core_words]
        state = home, STATE, None, _packed(total), _packed(np.full(len(total), classes, np.uint8)), zstandard.compress(b" ".join([words[i] for i in most]), 1), _packed(np.array(most, np.int32))
        return _home_rows([state] + [(home, block, _packed(which), None, None, None, None) for block, which in ids.items()])

    return lists.groupBy("home").applyInArrow(run, HOME)


def frequent_words(states: DataFrame, core_words: int) -> list[tuple[bytes, int]]:
    """The most frequent training words and their counts, equal counts by word."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                ids = _unpacked(row["top_ids"], np.int32)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(_words(row["top"]), pa.binary()), pa.array(_unpacked(row["counts"], np.int64)[ids])], ["word", "c"])

    top = states.select("counts", "top", "top_ids").mapInArrow(run, "word binary, c bigint").orderBy(F.desc("c"), "word").limit(core_words)
    return [(bytes(r["word"]), r["c"]) for r in top.collect()]


def core_bigrams(blocks: DataFrame, core: dict[bytes, int]) -> DataFrame:
    """(a, b, n): counts of neighbouring training tokens that are both in the core."""
    size = len(core)

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                seq = _of_core(_words(row["words"]), core)[_training(row)]
                both = (seq[:-1] >= 0) & (seq[1:] >= 0)
                pair, n = np.unique(seq[:-1][both] * size + seq[1:][both], return_counts=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(pair // size, pa.int32()), "b": pa.array(pair % size, pa.int32()), "n": pa.array(n, pa.int64())})

    return blocks.select("tokens", "lens", "train", "end", "words").mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(class of each word, class bigram counts) by exchange on a matrix of word bigram counts, most frequent word first."""
    size = len(pairs)
    of = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    right, left = pairs @ member, pairs.T @ member  # by class of the next and of the previous word
    between = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(size):
            a, self_n = of[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= self_n
            l[a] -= self_n
            between[a] -= r
            between[:, a] -= l
            between[a, a] -= self_n
            rows, cols = between.sum(axis=1), between.sum(axis=0)
            gain = (_xlogx(between + r[None, :]) - _xlogx(between)).sum(axis=1) + (_xlogx(between + l[:, None]) - _xlogx(between)).sum(axis=0)
            own = np.diag(between)
            gain += _xlogx(own + r + l + self_n) - _xlogx(own + r) - _xlogx(own + l) + _xlogx(own)
            gain -= _xlogx(rows + r.sum() + self_n) - _xlogx(rows) + _xlogx(cols + l.sum() + self_n) - _xlogx(cols)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            between[b] += r
            between[:, b] += l
            between[b, b] += self_n
            if b != a:
                of[w], moved = b, moved + 1
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return of, between


PAIRS = -1  # in place of a home: class bigrams of the block
EVIDENCE = "home bigint, block bigint, sizes binary, codes binary, n binary"


def _evidence(row, kinds: np.ndarray, bounds: list[tuple[int, int, int]], classes: int):
    """Neighbour counts of a block's words for their homes (home, from, to), and the block's class bigrams.

    A code is the class of a word before, or after it by ``classes`` + 1 more; ``classes`` stands for none. Counts over 255 repeat the code.
    """
    width = 2 * (classes + 1)
    number = np.int32 if len(kinds) * width < 1 << 31 else np.int64
    seq = _training(row).astype(number)
    kind = kinds[seq].astype(number)
    both = (kind[:-1] < classes) & (kind[1:] < classes)
    pairs = np.bincount(kind[:-1][both] * classes + kind[1:][both], minlength=classes * classes)
    before, after = kind[:-1] < classes, kind[1:] < classes
    keys = np.concatenate([(seq[1:] * width + kind[:-1])[before], (seq[:-1] * width + kind[1:] + classes + 1)[after]])  # the end token before the first text counts as one
    del seq, kind, both, before, after
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(keys)))
    times = -(-n // 255)
    key = np.repeat(keys[first], times)
    amount = np.full(len(key), 255, np.uint8)
    amount[np.cumsum(times) - 1] = n - (times - 1) * 255
    size = np.bincount(key // width, minlength=len(kinds)).astype(np.uint32)
    code, upto = (key % width).astype(np.uint8), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    block = row["block"].as_py()
    out = [(PAIRS, block, b"", _packed(pairs), b"")]
    for home, a, b in bounds:
        s = slice(upto[a], upto[b])
        out.append((home, block, _packed(size[a:b]), _packed(code[s]), _packed(amount[s])))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), *[pa.binary()] * 3])], [c.split()[0] for c in EVIDENCE.split(", ")])


def evidence_of_core(blocks: DataFrame, core: dict[bytes, int], of: np.ndarray, classes: int, homes: int) -> DataFrame:
    """Neighbour counts of every word, where only words of the core have a class."""
    known = np.append(of, classes)

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                words = _words(row["words"])
                home = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(homes) >> np.uint64(32)
                cut = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), len(words)]
                bounds = [(int(home[a]), a, b) for a, b in zip(cut, cut[1:])]
                yield from _evidence(row, known[_of_core(words, core)], bounds, classes).to_batches()

    return blocks.select("block", "tokens", "lens", "train", "end", "words").mapInArrow(run, EVIDENCE)


def _answers(right: pa.Table, kind, column: str):
    """(values by place in the block's list, bounds of the homes) from the rows of a block's homes."""
    rows = sorted(_rows(right), key=lambda r: r["home"].as_py())
    parts = [_unpacked(r[column], kind) for r in rows]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return np.concatenate(parts), [(r["home"].as_py(), a, b) for r, a, b in zip(rows, [0, *ends], ends)]


def evidence(blocks: DataFrame, homes: DataFrame, classes: int) -> DataFrame:
    """Neighbour counts of every word under the classes that the homes hold."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, bounds = _answers(right, np.uint8, "classes")
        return _evidence(next(_rows(left)), kinds, bounds, classes)

    left = blocks.select("block", "tokens", "lens", "train", "end")
    return left.groupBy("block").cogroup(homes.filter(F.col("block") != STATE).select("home", "block", "classes").groupBy("block")).applyInArrow(run, EVIDENCE)


def class_bigrams(found: DataFrame, classes: int) -> np.ndarray:
    """Class bigrams of all blocks of an evidence table."""

    def run(batches):
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for row in _rows(batch):
                total += _unpacked(row["codes"], np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    return _matrix(found.filter(F.col("home") == PAIRS).select("codes").mapInArrow(run, "pair bigint, n bigint"), classes)


def _matrix(pairs: DataFrame, classes: int) -> np.ndarray:
    out = np.zeros(classes * classes)
    for pair, n in pairs.groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(classes, classes)


def best_classes(counts: np.ndarray, between: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class of each word under which its neighbours are most likely, class bigrams being fixed but for its own counts.

    ``counts`` has a word's neighbours by code, ``own`` its present class (the number of classes: none, so nothing to remove). Equal classes: the present one,
    then the first.
    """
    classes = len(between)
    before, after = counts[:, :classes].astype(np.float64), counts[:, classes + 1 : -1].astype(np.float64)
    smooth = between + 0.5
    row, column = smooth.sum(axis=1), smooth.sum(axis=0)
    gain = before @ (np.log(smooth) - np.log(column)[None, :]) + after @ (np.log(smooth) - np.log(row)[:, None]).T
    at = np.flatnonzero(own < classes)
    a, left, right = own[at], before[at], after[at]
    ins, outs = np.maximum(smooth.T[a] - left, 0.5), np.maximum(smooth[a] - right, 0.5)
    total_in, total_out = np.maximum(column[a] - left.sum(axis=1), 0.5), np.maximum(row[a] - right.sum(axis=1), 0.5)
    gain[at, a] = (left * np.log(ins)).sum(axis=1) - left.sum(axis=1) * np.log(total_in) + (right * np.log(outs)).sum(axis=1) - right.sum(axis=1) * np.log(total_out)
    best = gain.argmax(axis=1)
    best[at] = np.where(gain[at, a] >= gain[at, best[at]] - 1e-9, a, best[at])
    return best


def reassign(homes: DataFrame, found: DataFrame, between: np.ndarray, start: dict[bytes, int] | None) -> DataFrame:
    """The homes with every word in its best class. ``start``: classes of the words that exchange has placed and that stay; None: all may move."""
    classes = len(between)
    width = 2 * (classes + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, state = {}, None
        for row in _rows(left):
            if row["block"].as_py() == STATE:
                state = row
            else:
                ids[row["block"].as_py()] = _unpacked(row["ids"], np.int32)
        home, total, kinds = state["home"].as_py(), _unpacked(state["counts"], np.int64), _unpacked(state["classes"], np.uint8).copy()
        word, code, n = [], [], []
        for row in _rows(right):
            word.append(np.repeat(ids[row["block"].as_py()], _unpacked(row["sizes"], np.uint32)))
            code.append(_unpacked(row["codes"], np.uint8)), n.append(_unpacked(row["n"], np.uint8))
        word, code, n = map(np.concatenate, (word, code, n))
        order = np.argsort(word, kind="stable")
        word, code, n = word[order].astype(np.int64), code[order], n[order]
        chosen = np.empty(len(kinds), np.uint8)
        for at in range(0, len(kinds), 20_000):
            upto = min(at + 20_000, len(kinds))
            s = slice(*np.searchsorted(word, [at, upto]))
            counts = np.bincount((word[s] - at) * width + code[s], n[s], (upto - at) * width).reshape(-1, width)
            chosen[at:upto] = best_classes(counts, between, kinds[at:upto].astype(np.int64))
        if start is not None and len(_unpacked(state["top_ids"], np.int32)):
            for i, w in zip(_unpacked(state["top_ids"], np.int32).tolist(), _words(state["top"])):
                chosen[i] = start.get(w, chosen[i])
        kinds = np.where(total > 0, chosen, classes).astype(np.uint8)
        rows = [(home, STATE, None, state["counts"].as_py(), _packed(kinds), state["top"].as_py(), state["top_ids"].as_py())]
        return _home_rows(rows + [(home, block, _packed(which), _packed(total[which]), _packed(kinds[which]), None, None) for block, which in ids.items()])

    return homes.groupBy("home").cogroup(found.filter(F.col("home") != PAIRS).groupBy("home")).applyInArrow(run, HOME)


def class_sizes(states: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(training tokens, words that occur once) of each class."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                total, kinds = _unpacked(row["counts"], np.int64), _unpacked(row["classes"], np.uint8)
                yield pa.RecordBatch.from_pydict({"class": pa.array(range(classes), pa.int32()), "n": np.bincount(kinds, total, classes + 1)[:classes].astype(np.int64), "ones": np.bincount(kinds[total == 1], minlength=classes + 1)[:classes]})

    size, singles = np.zeros(classes), np.zeros(classes)
    for k, n, ones in states.select("counts", "classes").mapInArrow(run, "class int, n bigint, ones bigint").groupBy("class").agg(F.sum("n"), F.sum("ones")).collect():
        size[k], singles[k] = n, ones
    return size, singles


def code_blocks(blocks: DataFrame, homes: DataFrame) -> DataFrame:
    """The blocks with each of their words' class and count (no class and 0: not in training) in place of the words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, _ = _answers(right, np.uint8, "classes")
        counts, _ = _answers(right, np.int64, "counts")
        return left.append_column("classes", pa.array([_packed(kinds)], pa.binary())).append_column("n", pa.array([_packed(counts)], pa.binary()))

    slim = blocks.select("block", "ids", "lens", "train", "tokens", "end")
    answers = homes.filter(F.col("block") != STATE).select("home", "block", "classes", "counts")
    id_type = blocks.schema["ids"].dataType.simpleString()
    return slim.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"block bigint, ids {id_type}, lens binary, train binary, tokens binary, end int, classes binary, n binary")


def transitions(coded: DataFrame, classes: int) -> np.ndarray:
    """Counts of (previous class, class) over training tokens; the token before a text is the end token."""

    def run(batches):
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for row in _rows(batch):
                seq = _unpacked(row["classes"], np.uint8)[_training(row)].astype(np.int64)
                total += np.bincount(seq[:-1] * classes + seq[1:], minlength=classes * classes) if len(seq) > 1 else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    return _matrix(coded.select("tokens", "lens", "train", "end", "classes").mapInArrow(run, "pair bigint, n bigint"), classes)


class Model:
    """Class transitions and emissions; ``share`` of the probability comes from classes, the rest from word frequencies."""

    def __init__(self, pairs: np.ndarray, class_tokens: np.ndarray, class_singles: np.ndarray, tokens: int, types: int, share: float):
        classes = len(pairs)
        self.tokens, self.types, self.share = tokens, types, share if tokens else 0.0
        even = class_tokens / max(1, class_tokens.sum())
        follow = (pairs > 0).sum(axis=1, keepdims=True)  # Witten-Bell: unseen successors weigh as the seen kinds do
        self.next = np.vstack([(pairs + follow * even) / np.maximum(1, pairs.sum(axis=1, keepdims=True) + follow), even])
        self.next[:-1][pairs.sum(axis=1) == 0] = even
        self.class_tokens = np.maximum(1, class_tokens)
        fresh = np.minimum(0.5, class_singles / self.class_tokens)  # chance of a word not seen in training, by singletons
        self.seen = np.append(1 - fresh, 0.0)
        self.class_tokens = np.append(self.class_tokens, 1)
        self.unseen = self.next @ fresh
        self.classes = classes

    def frequency(self, n: np.ndarray) -> np.ndarray:
        return (n + 1) / (self.tokens + self.types + 1)

    def log10(self, kind: np.ndarray, n: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each token, from its class (``classes``: unknown), its count and the class of the one before."""
        known = kind < self.classes
        by_class = self.next[before, np.minimum(kind, self.classes - 1)] * self.seen[kind] * n / self.class_tokens[kind]
        by_class = np.where(known, by_class, self.unseen[before])
        return np.log10(self.share * by_class + (1 - self.share) * self.frequency(n))


def score_blocks(coded: DataFrame, model: Model) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, score) of every text."""
    id_type = coded.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                lens, train = _unpacked(row["lens"], np.int32), _unpacked(row["train"], np.uint8)
                kinds, counts = _unpacked(row["classes"], np.uint8), _unpacked(row["n"], np.int64)
                tokens = _unpacked(row["tokens"], np.int32)
                base, score, known = (np.zeros(len(lens)) for _ in range(3))
                start = np.concatenate([[0], np.cumsum(lens)])
                end = kinds[[row["end"].as_py()]]
                doc = 0
                while doc < len(lens):  # texts of about 200,000 tokens at a time
                    last = max(doc + 1, int(np.searchsorted(start, start[doc] + 200_000)))
                    last = min(last, len(lens))
                    part = tokens[start[doc] : start[last]]
                    kind, n = kinds[part], counts[part]
                    before = np.concatenate([end, kind[:-1]])
                    cut = start[doc:last] - start[doc]
                    base[doc:last] = np.add.reduceat(np.log10(model.frequency(n)), cut)
                    score[doc:last] = np.add.reduceat(model.log10(kind, n, before), cut)
                    known[doc:last] = np.add.reduceat(n > 0, cut, dtype=np.int64)
                    doc = last
                yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(train == 0), pa.array(lens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return coded.mapInArrow(run, f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", classes: int = 64, core_words: int = 2048, rounds: int = 2, share: float = 0.9) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity): a model learned from the rows where
    ``held_out`` (a boolean column expression) is not true, and its log10 probability of every text.

    Text is split at white space after lower-casing A-Z; each text ends with one end token. Null text is empty. Every word of the training texts gets a
    class from the counts of all its neighbours; ``core_words`` only bounds how many start with the sequential exchange, ``rounds`` how often all words are
    reassigned. Without training texts the score is the base score. Repeated and null ids keep their rows. An empty table gives no rows.
    Two to 127 classes, as a neighbour's class and side are stored in a byte.
    """
    if not 2 <= classes <= 127:
        raise ValueError("classes must be from 2 to 127")
    spark = docs.sparkSession
    scratch = Scratch(spark, "brown")
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = scratch.put(encode_blocks(rows), "blocks")
    n_homes = max(1, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // HOME_WORDS))
    homes = scratch.put(settle(word_lists(blocks, n_homes), classes, core_words), "homes0")
    top = frequent_words(homes.filter(F.col("block") == STATE), core_words)
    core = {w: i for i, (w, _) in enumerate(top)}
    pairs = np.zeros((len(core), len(core)))
    table = core_bigrams(blocks, core).toArrow()
    pairs[table.column("a").to_numpy(), table.column("b").to_numpy()] = table.column("n").to_numpy()
    of, between = exchange(pairs, classes)
    start = {w: int(k) for w, k in zip(core, of)}
    for turn in range(max(1, rounds)):
        found = evidence(blocks, homes, classes) if turn else evidence_of_core(blocks, core, of, classes, n_homes)
        found = scratch.put(found, f"evidence{turn}")
        between = class_bigrams(found, classes) if turn else between
        homes = scratch.put(reassign(homes, found, between, None if turn else start), f"homes{turn + 1}")
        scratch.drop(f"evidence{turn}")
        scratch.drop(f"homes{turn}")
        scratch.release()
    states = homes.filter(F.col("block") == STATE)
    coded = scratch.put(code_blocks(blocks, homes), "coded")
    size, singles = class_sizes(states, classes)
    types = _known_words(states)
    scratch.drop("blocks")
    tokens = int(size.sum())
    model = Model(transitions(coded, classes), size, singles, tokens, types, share)
    out = score_blocks(coded, model).withColumn("train_tokens", F.lit(tokens).cast("bigint"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _known_words(states: DataFrame) -> int:
    """Distinct training words."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([int((_unpacked(v, np.int64) > 0).sum()) for v in batch.column("counts")], pa.int64())})

    return states.select("counts").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
