"""Resampling of documents towards a target distribution, by an external sort-count of hashed n-grams.

Each document's n-grams are hashed into at most 65,536 buckets. The bucket numbers are stored as packed uint16 streams, a block of
documents a row, with the offset at which each document begins. Counts come from the streams: a block is sorted and run-length
encoded, and only the runs, at most one a bucket and task, are shuffled. When the counts of both corpora have given every bucket its
gain, the stored streams are read again: gains are gathered by bucket and summed per document with ``np.add.reduceat``. So texts are
read once, and the second pass reads two bytes an n-gram.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructType

from ..operators.ranking import numbered
from ._common import Scratch, text_bytes

BLOCK = 1 << 20  # n-grams after which a block is closed
BLOCK_DOCUMENTS = 4096
#: Per byte, what stands for it in n-grams: letters and digits (A-Z lower-cased) and all bytes of other alphabets are themselves, the rest blanks.
_CLASS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_CLASS).split()


def _stream(found: list[bytes], least: int, most: int, buckets: int) -> np.ndarray:
    """The buckets of all runs of ``least`` to ``most`` consecutive words."""
    out = []
    for n in range(least, most + 1):
        grams = found if n == 1 else map(b" ".join, zip(*[found[k:] for k in range(n)]))
        out.append(np.fromiter(map(crc32, grams), np.uint32) % np.uint32(buckets))
    return np.concatenate(out).astype(np.uint16)


def bucket_streams(docs: DataFrame, n: tuple[int, int], buckets: int) -> DataFrame:
    """(ids, n_words, offsets, stream) a block of documents, from (id, text as bytes); ``offsets`` has one more than ids, in n-grams."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in 16 bits")
    if not 0 < n[0] <= n[1]:
        raise ValueError("n must be a range of lengths from 1 on")
    longs = ArrayType(LongType())
    schema = StructType().add("ids", ArrayType(docs.schema["id"].dataType)).add("n_words", longs).add("offsets", longs).add("stream", "binary")

    def block(ids: list[pa.Array], counts: list[int], streams: list[np.ndarray]) -> pa.RecordBatch:
        ids = pa.concat_arrays(ids)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays(
            [one(ids), one(pa.array(counts, pa.int64())), one(pa.array(offsets, pa.int64())), pa.array([np.concatenate(streams).tobytes()], pa.binary())],
            ["ids", "n_words", "offsets", "stream"],
        )

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            first, held, counts, streams = 0, 0, [], []
            for i in range(batch.num_rows):
                found = words(texts[i].as_py())
                counts.append(len(found))
                streams.append(_stream(found, *n, buckets))
                held += len(streams[-1])
                if held >= BLOCK or len(counts) >= BLOCK_DOCUMENTS or i + 1 == batch.num_rows:
                    yield block([ids.slice(first, i + 1 - first)], counts, streams)
                    first, held, counts, streams = i + 1, 0, [], []

    return docs.select("id", "text").mapInArrow(run, schema)


def bucket_counts(streams: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): sorted blocks as runs, added up in the task and then over tasks."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("stream"):
                ordered = np.sort(np.frombuffer(value.as_buffer(), np.uint16))
                if len(ordered):
                    starts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
                    total[ordered[starts]] += np.diff(np.concatenate([starts, [len(ordered)]]))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})

    return streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths, rounded down, of each bucket's log ratio of target to raw frequency, one n-gram a bucket added to both."""
    n = len(raw)
    all_raw, all_target = float(raw.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def _weights(streams: DataFrame, gain: np.ndarray, id_type: DataType) -> DataFrame:
    """(id, n_words, n_features, weight) from the stored streams; the gains, one number a bucket, are broadcast."""
    shared = streams.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                offsets = batch.column("offsets")[i].values.to_numpy()
                values = gain[np.frombuffer(batch.column("stream")[i].as_buffer(), np.uint16)]
                sizes = np.diff(offsets)
                some = sizes > 0
                weight = np.zeros(len(sizes), np.int64)
                if some.any():
                    weight[some] = np.add.reduceat(values, offsets[:-1][some]) // sizes[some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("n_words")[i].values, pa.array(sizes, pa.int64()), pa.array(weight)],
                    ["id", "n_words", "n_features", "weight"],
                )

    return streams.mapInArrow(run, StructType().add("id", id_type).add("n_words", "long").add("n_features", "long").add("weight", "long"))


def noise(id_col: Column, seed: int) -> Column:
    """Thousandths, rounded down, of Gumbel noise drawn by the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", n: tuple[int, int] = (1, 1),
    buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ``rank``, from 1, is that of the drawn ones, null elsewhere.

    Drawn are, of the documents with at least ``least_words`` words, the ``percent`` of highest score, which is the mean gain of their
    n-grams plus Gumbel noise: sampling without replacement in proportion to importance. Ties go to the smaller id, nulls first. Null
    and empty texts have no words, a weight of 0 and a score of noise alone. Rows with the same id share one draw, rows without an id
    that of an empty one; both count each and have places next to each other. An empty target or table of documents counts nothing; no
    documents give no rows. Other columns are not read, whatever their names.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "target-sampling")
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    streams = scratch.put(bucket_streams(rows, n, buckets), "streams")
    wanted = bucket_streams(target.select(F.lit(0).alias("id"), text_bytes(target_text_col).alias("text")), n, buckets)
    both = bucket_counts(streams, buckets).select("bucket", "n", F.lit(0).alias("side")).unionByName(bucket_counts(wanted, buckets).select("bucket", "n", F.lit(1).alias("side")))
    counts = np.zeros((2, buckets), np.int64)
    for r in both.collect():  # at most two rows a bucket
        counts[r["side"], r["bucket"]] = r["n"]
    found = _weights(streams, gains(*counts), rows.schema["id"].dataType)
    found = found.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    placed = numbered(found, [F.desc("eligible"), F.desc("score"), F.col("id")], "place", 1)
    k = placed.filter("eligible").count() * percent // 100
    return placed.select("id", "n_words", "n_features", "weight", "score", F.when(F.col("eligible") & (F.col("place") <= k), F.col("place")).alias("rank"))


def sampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The drawn documents themselves, in the columns they came with. Ids are taken to be unique and not null."""
    drawn = resample(docs, target, id_col, **parameters).filter("rank is not null").select(F.col("id").alias(id_col))
    return docs.join(drawn, id_col, "left_semi")
