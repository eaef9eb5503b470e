"""SimHash near-duplicates: 64-bit fingerprints, exact tiled comparison, connected components.

Fingerprints are compared only once per distinct value. A tile holds the fingerprints whose four 16-bit
quarters have the same population counts; two fingerprints within the radius have counts that differ by no
more than the radius in sum, so all other tile pairs are skipped. Tiles are compared with numpy exclusive-or and
bit counts; a tile with too many fingerprints is cut into parts that visit each other. Each part hands on a spanning forest
of the links it found, not the pairs.
"""

from __future__ import annotations

from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import Scratch, forest, stream_tiles, text_bytes
from .components import connected_components

SIDE = 17  # a quarter's population count is 0 to 16
#: byte -> eight byte-wide counters in one word, bit i in counter i
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``shingle`` words in a row of UTF-8 text, of all words if there are fewer; none without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, n)


def simhash(h: np.ndarray) -> int:
    """Each bit is that of most hashes; zero without any."""
    n = len(h)
    if not n:
        return 0
    spread = _SPREAD[h.view(np.uint8)].reshape(n, 8)
    blocks = np.add.reduceat(spread, np.arange(0, n, 255), axis=0)  # a byte-wide counter holds 255
    ones = blocks.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of UTF-8 text over word shingles hashed by XXH64 (seed 42), repeats included."""
    return simhash(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): one row per input row; null and blank texts get zero."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint"

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, schema)


def quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, shape (n, 4)."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int64)


def _offsets(radius: int) -> np.ndarray:
    """Differences of quarter counts within the radius that point to a larger tile number."""
    found = [o for o in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, o)) <= radius]
    return np.array([o for o in found if o > (0, 0, 0, 0)])


_WEIGHT = SIDE ** np.arange(3, -1, -1)


def _visits(radius: int, parts: np.ndarray):
    offsets = _offsets(radius)

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            counts = quarters(fp)
            home = counts @ _WEIGHT
            part = (fp % np.uint64(1_000_003)).astype(np.int64) % np.maximum(parts[home], 1)
            out = [((home << 32) | part, np.zeros(len(fp), np.int8), fp)]
            for offset in offsets:
                near = counts + offset
                tile = np.where(((near >= 0) & (near < SIDE)).all(axis=1), near @ _WEIGHT, -1)
                times = np.where(tile >= 0, parts[tile], 0)
                out.append(_spread(tile, times, fp))
            out.append(_spread(home, part, fp))  # the parts before its own
            for tile, role, value in out:
                for at in range(0, len(tile), 50_000):
                    cut = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(tile[cut]), pa.array(role[cut]), pa.array(value[cut].view(np.int64))], ["tile", "role", "fp"])

    return run


def _spread(tile, times, fp):
    which = np.repeat(np.arange(len(fp)), times)
    part = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return (tile[which] << 32) | part, np.ones(len(which), np.int8), fp[which]


def _compare(radius: int):
    def links(x, y, same=False):
        """A spanning forest of the links within x, or between x and y."""
        found_i, found_j = [], []
        step = max(1, 2_000_000 // max(1, len(y)))
        for at in range(0, len(x), step):
            i, j = np.nonzero(np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= radius)
            i = i + at
            if same:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j + (0 if same else len(x)))
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        if not len(i):
            return
        nodes = x if same else np.concatenate([x, y])
        label = forest(len(nodes), i, j)
        child = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child].view(np.int64)), pa.array(nodes[label[child]].view(np.int64))], ["a", "b"])

    def values(batch):
        return batch.column("fp").to_numpy().view(np.uint64)

    def close(hosts):
        x = np.concatenate([values(b) for b in hosts])
        return x, links(x, x, same=True)

    def visit(x, batch):
        return links(x, values(batch))

    return lambda batches: stream_tiles(batches, close, visit)


def fingerprint_links(distinct: DataFrame, radius: int = 2, tile_rows: int = 4096) -> DataFrame:
    """(a, b): links that connect all of a table of distinct fingerprints (fp long) at most ``radius`` bits apart.

    The links span each connected group without listing all of its pairs. Only the number of fingerprints per
    tile, at most 17**4 numbers however large the table, passes through the driver.
    """
    by_tile = lambda: lambda batches: (pa.RecordBatch.from_arrays([pa.array(quarters(b.column("fp").to_numpy().view(np.uint64)) @ _WEIGHT)], ["tile"]) for b in batches)
    sizes = distinct.select("fp").mapInArrow(by_tile(), "tile bigint").groupBy("tile").count().collect()
    parts = np.zeros(SIDE**4, np.int64)
    for tile, n in sizes:
        parts[tile] = -(-n // tile_rows)
    visits = distinct.select("fp").mapInArrow(_visits(radius, parts), "tile bigint, role tinyint, fp bigint")
    return visits.repartition("tile").sortWithinPartitions("tile", "role").mapInArrow(_compare(radius), "a bigint, b bigint")


def _classes(fps: DataFrame, scratch: Scratch, radius: int, tile_rows: int) -> DataFrame:
    """(fp, least, root): each distinct fingerprint, its smallest id and the smallest fingerprint it is linked to."""
    distinct = scratch.put(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = connected_components(fingerprint_links(distinct, radius, tile_rows), scratch)
    return distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, tile_rows: int = 4096) -> DataFrame:
    """(id, fp long, component): component is the smallest id among the documents reachable by links.

    One row per input row, copies included. Null text counts as empty; texts without words share fingerprint
    zero and link like any other. Repeated ids keep their rows. Null ids never name a component unless all of its
    ids are null. An empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.put(fingerprints(docs, id_col, text_col, shingle), "fps")
    member = _classes(fps, scratch, radius, tile_rows)
    smallest = member.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.put(member.join(smallest, "root").select(F.col("fp").alias("value"), "component"), "named")
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    left = fps.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    return left.join(salted, (left.fp == salted.value) & (left.salt == salted.salt)).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, tile_rows: int = 4096) -> DataFrame:
    """The documents of which no linked one has a smaller id, in the columns they came with: one row per component.

    A component's row is that of its smallest id (null only if all are null), of the smallest fingerprint among those, and
    one of any rows that share both.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.put(fingerprints(docs, id_col, text_col, shingle), "fps")
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "fp")).alias("first")
    kept = _classes(fps, scratch, radius, tile_rows).groupBy("root").agg(first).select(F.col("first.least").alias("kept_id"), F.col("first.fp").alias("kept_fp"))
    place, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, FP])

    marked = docs.mapInArrow(run, StructType([*docs.schema.fields]).add(FP, "long"))
    kept = scratch.put(kept, "kept")
    match = marked[id_col].eqNullSafe(kept.kept_id) & (marked[FP] == kept.kept_fp)
    return marked.join(kept, match, "left_semi").dropDuplicates([id_col, FP]).select(*names)


FP = "__simhash__"
SALTS = 8  # one fingerprint may hold a third of all rows
