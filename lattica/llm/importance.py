"""Quality classification by importance resampling.

Two generative models over hashed n-grams, one of target text (documents labelled good) and one of the raw text (all documents),
give each document a log importance ratio; Gumbel noise is added and the k largest are kept, which samples k documents
without replacement in proportion to their importance.

N-grams are words, pairs of neighbouring words, openings of 5 and 7 letters, and repeats of a word in a row up to the fourth; pairs have
buckets of their own. A document counts each once in the models and as often as it occurs in its score. An n-gram's
smoothed ratio, above or below one, is used where target and expectation differ by more than ``deviations`` standard
deviations; elsewhere it is one, as the many n-grams that are too rare to tell would else add up to noise.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import Scratch
from ._common import packed as _packed
from ._common import unpacked as _unpacked

CHUNK = 4096  # buckets sent together
DOCUMENTS = -1  # in place of a chunk: numbers of documents
PAIR_A, PAIR_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd numbers that mix two hashes
_TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE_WORDS = 300_000  # only speed depends on it
PART = 256  # texts at a time


class NGrams(dict):
    """Numbers the words of texts and keeps the hashed n-grams of each; the n-grams of all words stand in one flat array.

    Buckets below 2**bits are those of single words, the same number above them those of pairs.
    """

    def __init__(self, bits: int):
        import xxhash

        self.bits, self.full_hash = bits, xxhash.xxh64_intdigest
        self.repeats = np.array([self.hash(f"={k}") for k in (1, 2, 3, 4)])
        self.forget()

    def hash(self, token: str) -> int:
        return self.full_hash(token) >> (64 - self.bits)

    def forget(self) -> None:
        self.clear()
        self.flat, self.first, self.codes = array("q"), array("q", [0]), array("Q")

    def __missing__(self, word: str) -> int:
        tokens = _TOKEN.findall(word)
        self.flat.extend([self.hash(t) for t in tokens])
        self.flat.extend([self.hash("^" + t[:n]) for t in tokens if t[0].isalpha() for n in (5, 7) if len(t) > n])
        self.first.append(len(self.flat))
        self.codes.append(self.full_hash("".join(filter(str.isalnum, word)) or word))  # in pairs words stand without punctuation
        self[word] = number = len(self.first) - 2
        return number

    def texts(self, texts: list[str]):
        """For each text: its words that do not repeat the one before, as numbers, and its repeats, as n-grams."""
        if len(self) > CACHE_WORDS:
            self.forget()
        out = []
        for text in texts:
            words = text.lower().split()
            ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            again = np.zeros(len(ids), bool)
            again[1:] = ids[1:] == ids[:-1]
            if again.any():
                at = np.arange(len(ids))
                run = at - np.maximum.accumulate(np.where(again, 0, at))
                out.append((ids[~again], self.repeats[np.minimum(run[again], 4) - 1]))
            else:
                out.append((ids, self.repeats[:0]))
        return out

    def views(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams, first n-gram of each word and the end, hash of each word); to be dropped before further texts."""
        return np.frombuffer(self.flat, np.int64), np.frombuffer(self.first, np.int64), np.frombuffer(self.codes, np.uint64)

    def expand(self, ids: np.ndarray) -> np.ndarray:
        """The n-grams of single words of a sequence of words."""
        flat, first, _ = self.views()
        n = first[ids + 1] - first[ids]
        at = np.arange(n.sum()) + np.repeat(first[ids] - (np.cumsum(n) - n), n)
        return flat[at]

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """The n-grams of two words of a sequence of words."""
        codes = np.frombuffer(self.codes, np.uint64)[ids]
        mixed = (codes[:-1] * np.uint64(PAIR_A) + codes[1:]) * np.uint64(PAIR_B)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64) + (1 << self.bits)


def _counts(bits: int):
    size = 2 << bits

    def run(batches):
        grams = NGrams(bits)
        raw, target = np.zeros(size, np.int32), np.zeros(size, np.int32)
        place = np.zeros(size, np.int64)
        documents = np.zeros(2, np.int64)
        for batch in batches:
            good = batch.column("good").to_pylist()
            for at in range(0, batch.num_rows, PART):
                part = [t or "" for t in batch.column("text").slice(at, PART).to_pylist()]
                for i, (ids, repeats) in enumerate(grams.texts(part), at):
                    which = np.concatenate([grams.expand(ids), repeats, grams.pairs(ids)])
                    order = np.arange(len(which))
                    place[which] = order  # of equal n-grams one remains
                    which = which[place[which] == order]
                    raw[which] += 1
                    if good[i]:
                        target[which] += 1
            documents += [batch.num_rows, sum(map(bool, good))]
        for k in range(0, size, CHUNK):
            r, t = raw[k : k + CHUNK], target[k : k + CHUNK]
            if r.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // CHUNK], pa.int32()), "raw": pa.array([_packed(r)], pa.binary()), "target": pa.array([_packed(t)], pa.binary())})
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([DOCUMENTS], pa.int32()), "raw": pa.array([_packed(documents[:1].astype(np.int32))], pa.binary()), "target": pa.array([_packed(documents[1:].astype(np.int32))], pa.binary())})

    return run


def _sum_chunks(group: pa.Table) -> pa.Table:
    out = {"chunk": pa.array([group.column("chunk")[0].as_py()], pa.int32())}
    for name in ("raw", "target"):
        total = sum(_unpacked(value, np.int32).astype(np.int64) for value in group.column(name))
        out[name] = pa.array([_packed(total)], pa.binary())
    return pa.table(out)


def log_ratios(docs: DataFrame, bits: int = 20, smoothing: float = 2.0, deviations: float = 3.0) -> np.ndarray:
    """Log ratio of the target to the raw model for each of 2**bits buckets of single words, then as many of pairs, from columns text and good.

    Each task sends its counts in packed chunks, added up on the executors; the driver gets two numbers a bucket.
    """
    chunks = docs.select("text", "good").mapInArrow(_counts(bits), "chunk int, raw binary, target binary")
    chunks = chunks.groupBy("chunk").applyInArrow(_sum_chunks, "chunk int, raw binary, target binary").toArrow()
    raw, target = np.zeros(2 << bits), np.zeros(2 << bits)
    documents = np.zeros(2)
    for chunk, r, t in zip(*chunks.columns):
        r, t, at = _unpacked(r, np.int64), _unpacked(t, np.int64), chunk.as_py() * CHUNK
        if at < 0:
            documents = np.array([r[0], t[0]])
        else:
            raw[at : at + CHUNK], target[at : at + CHUNK] = r, t
    share = target.sum() / max(1.0, raw.sum())
    expected = raw * share
    ratio = np.log((target + smoothing) / (expected + smoothing))
    spread = np.sqrt((expected + 1) * (1 - min(1.0, documents[1] / max(1.0, documents[0]))))
    return np.where(np.abs(target - expected) > deviations * spread, ratio, 0.0).astype(np.float32)


def scored(docs: DataFrame, ratios: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their log importance ratio, ``log_ratio`` (last; double; a column of that name is replaced)."""
    docs = docs.drop("log_ratio")
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 2**(bits + 1) numbers
    bits = len(ratios).bit_length() - 2
    place = docs.columns.index(text_col)

    def run(batches):
        grams, ratios = NGrams(bits), shared.value.astype(np.float64)
        by_word = np.zeros(0)
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, PART):
                found = grams.texts([t or "" for t in batch.column(place).slice(at, PART).to_pylist()])
                flat, first, _ = grams.views()
                done = len(by_word) if len(by_word) < len(first) else 0  # fewer words: the memory was cleared
                if done < len(first) - 1:
                    new = np.add.reduceat(ratios[flat[first[done] :]], first[done:-1] - first[done])
                    by_word = np.concatenate([by_word[:done], new])
                del flat, first, _
                out += [float(by_word[ids].sum() + ratios[repeats].sum() + ratios[grams.pairs(ids)].sum()) for ids, repeats in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "log_ratio"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("log_ratio", "double"))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of column ``key`` by narrowing histograms; None if there are no more than k rows."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n <= k:
        return None
    if k <= 0:
        return float("inf")
    above = 0
    while True:
        width = (high - low) / bins
        inside = keys.filter(F.col("key").between(low, high))
        if not width or low + width == low:
            return low
        place = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        rows = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect()
        for row in rows:
            if above + row["n"] >= k:
                break
            above += row["n"]
        low, high = row["low"], row["high"]
        if above + row["n"] == k or low == high:
            return low


class Resampler:
    """A fitted importance resampler: n-gram ratios, the number to keep, and every document's score and key."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 200_000, bits: int = 20, temperature: float = 0.25, seed: int = 42, carry: bool = False):
        """``labels`` has (id, good boolean). At most ``max_labels`` labelled ids, those of least hash, are used and broadcast.

        Without labels of both kinds every row is kept. Log ratios are divided by ``temperature`` before Gumbel noise, drawn by a hash of id and
        ``seed``, is added. As many rows are kept as reach the score that best separates the labels. Null and empty texts have a ratio of one (score 0). Rows
        with null ids are unlabelled and share one draw, as do rows with the same id: the same key if their texts score alike. An empty
        table keeps nothing. ``carry`` stores the documents with their scores, for ``kept_documents``.
        """
        spark = docs.sparkSession
        self.columns, self.id_col, self.text_col, self.temperature, self.seed = docs.columns, id_col, text_col, temperature, seed
        once = labels.filter("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
        sample = spark.createDataFrame(once.orderBy(F.xxhash64("id"), "id").limit(max_labels).toArrow())
        rest = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if carry and c not in (id_col, text_col)])
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest.alias("rest")).join(F.broadcast(sample), "id", "left")
        self.ratios = log_ratios(rows, bits)
        self.scratch = Scratch(spark, "importance")
        result = scored(rows, self.ratios)
        judged = self.scratch.put(result if carry else result.drop("text", "rest"), "scores")
        step = F.greatest(F.round("log_ratio", 2), F.lit(-1000.0))
        curve = judged.filter("good is not null").groupBy(step.alias("score"), "good").count().collect()
        self.cut = best_cut([(r["score"], r["good"], r["count"]) for r in curve])
        self.k = judged.filter(F.col("log_ratio") >= self.cut).count()
        self.judged = judged.drop("good").withColumn("gumbel_key", self._key("id"))
        self.least_key = kth_largest(self.judged.select(F.col("gumbel_key").alias("key")), self.k)

    def _key(self, id_name: str):
        uniform = (F.pmod(F.xxhash64(F.col(id_name), F.lit(self.seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.col("log_ratio") / F.lit(self.temperature) - F.log(-F.log(uniform))

    def kept(self) -> DataFrame:
        """(id, log_ratio, gumbel_key) of the documents among the k largest keys; equal keys at the end all stay."""
        return self._best().select("id", "log_ratio", "gumbel_key")

    def kept_documents(self) -> DataFrame:
        """The documents that are kept, in the columns they came with, read from the stored scores."""
        source = {self.id_col: "id", self.text_col: "text"}
        return self._best().select(*[F.col(source.get(c, f"rest.c{i}")).alias(c) for i, c in enumerate(self.columns)])

    def _best(self) -> DataFrame:
        return self.judged if self.least_key is None else self.judged.filter(F.col("gumbel_key") >= F.lit(self.least_key))


def best_cut(curve: list[tuple[float, bool, int]]) -> float:
    """The least score to count as good that maximises the sum of both classes' recall; minus infinity if a class lacks."""
    total = {g: sum(n for _, was, n in curve if was is g) for g in (True, False)}
    if not all(total.values()):
        return float("-inf")
    best, cut, good, bad = -1.0, float("-inf"), total[True], 0
    by_score: dict[float, list[int]] = {}
    for score, was, n in curve:
        by_score.setdefault(score, [0, 0])[was] += n
    for score in sorted(by_score):
        value = good / total[True] + bad / total[False]
        if value > best + 1e-12:
            best, cut = value, score
        good -= by_score[score][1]
        bad += by_score[score][0]
    return cut - 0.005  # scores were rounded to hundredths
