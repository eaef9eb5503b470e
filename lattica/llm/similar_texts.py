"""Near copies of texts by the Jaccard coefficient of word shingles: SimHash comparison of all texts, each link checked exactly.

Candidates are texts whose fingerprints of 256 bits, SimHashes of their sets of shingles, are within a radius, and the connected groups of
candidates are the tiles in which the shingle sets themselves are compared. Two texts at a coefficient of 0.8 differ in about ten bits of 64; at
a radius that wide population counts exclude nothing, but numbers of shingles do: at that coefficient none has over 1.25 times as many as the other.
So fingerprints are dealt into parts by size, and each part is compared with those that its sizes reach.

A tile with too many texts to hold is not compared pair by pair. First all its texts are compared with some of them, its pivots, which links
a group of copies whatever its size. Only texts that this leaves outside the tile's main group are then compared with all others, in blocks:
two texts that are known to be of one group need no link more. A connected group too large even for that is cut into overlapping cells of
sizes, which are compared in the same two steps.

Only the radius can miss: at coefficient 0.8 it is five standard deviations from the mean distance, four for texts of four or five shingles.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import free_names
from ._common import Scratch, forest, stream_tiles, text_bytes
from .components import connected_components
from .simhash import shingle_hashes, simhash

BITMAP = 32_768  # bits of one of Spark's bitmaps
#: A group or cell of more texts than this number and this share of all is met by broadcast, so there are few of them.
HOT_TEXTS, HOT_SHARE = 1000, 1024
LARGE = 25  # times the texts of a tile: a connected group of more is cut
GUESTS = 2  # texts that visit a block, for each that it holds
TILE = "tile", "n", "label", "m", "host", "guest"
WORDS = "w0", "w1", "w2", "w3"  # of a fingerprint
CLASS = math.log(1.01)  # sizes whose logarithms are of one multiple of it are one class
#: Parts that all fingerprints are dealt into, if a part then has at least and at most so many.
PRINT_PARTS, PRINT_ROWS = 32, (1024, 65_536)
CELLS = 1 << 18  # pairs that are compared at once


def words_key(text: bytes) -> int:
    """A signed 64-bit hash of the words in lower case: texts of equal words share it."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))).view(np.int64))


def wide_simhash(hashes: np.ndarray) -> list[int]:
    """SimHash of four words: the first is that of the hashes themselves, the others of hashes made from them."""
    words = [simhash(hashes)]
    for k in range(1, len(WORDS)):
        x = hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        words.append(simhash(x ^ (x >> np.uint64(31))))
    return words


def _signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, key, size, WORDS) of each row: the number of its shingles without repeats, and their fingerprint."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, key bigint, size bigint, {', '.join(f'{w} bigint' for w in WORDS)}"

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            words = np.array([wide_simhash(h) for h in sets], np.uint64).reshape(-1, len(WORDS)).view(np.int64)
            columns = [batch.column("id"), pa.array([words_key(t) for t in texts], pa.int64()), pa.array(map(len, sets), pa.int64()), *map(pa.array, words.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "size", *WORDS])

    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, schema)


class _Prints:
    """Fingerprints in the order of their sizes."""

    def __init__(self, batches):
        column = lambda name: np.concatenate([b.column(name).to_numpy() for b in batches])
        order = np.argsort(column("size"), kind="stable")
        self.key, self.size = column("key")[order], column("size")[order]
        self.words = [column(w)[order].view(np.uint64) for w in WORDS]


def _near(x: _Prints, y: _Prints, similarity: float, radius: int):
    """A spanning forest of the links between x and y, or within x if y is x, as batches (a, b).

    The first words may differ in ``radius`` bits, all four in three times as many. Sizes at which sets that differ cannot be similar must be equal in all.
    """
    same = x is y
    shift = 0 if same else len(x.key)
    label = np.arange(shift + len(y.key))
    found, pending, at = [], 0, 0

    def joined():
        child = np.flatnonzero(label != np.arange(len(label)))
        i, j = zip((child, label[child]), *found)
        return forest(len(label), np.concatenate(i), np.concatenate(j))

    while at < len(y.key):
        low = at if same else int(np.searchsorted(x.size, similarity * y.size[at] - 1e-9))
        high = int(np.searchsorted(x.size, y.size[at] / similarity + 1e-9, "right"))
        end = min(len(y.key), at + max(1, CELLS // max(1, high - low)))
        high = int(np.searchsorted(x.size, y.size[end - 1] / similarity + 1e-9, "right"))
        r, c = np.nonzero(np.bitwise_count(y.words[0][at:end, None] ^ x.words[0][None, low:high]) <= radius)
        r, c = r + at, c + low
        open_ = label[r + shift] != label[c]
        if same:
            open_ &= r < c
        r, c = r[open_], c[open_]
        few, many = np.minimum(y.size[r], x.size[c]), np.maximum(y.size[r], x.size[c])
        alike = (few < many) | (few - 1 >= similarity * (few + 1) - 1e-9)
        distance = sum(np.bitwise_count(b[r] ^ a[c]).astype(np.int64) for a, b in zip(x.words, y.words))
        linked = (distance <= np.where(alike, 3 * radius, 0)) & (few >= similarity * many - 1e-9)
        if linked.any():
            found.append((r[linked] + shift, c[linked]))
            pending += len(found[-1][0])
            if pending > CELLS:
                label, found, pending = joined(), [], 0
        at = end
    if found:
        label = joined()
    child = np.flatnonzero(label != np.arange(len(label)))
    if len(child):
        nodes = x.key if same else np.concatenate([x.key, y.key])
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[label[child]])], ["a", "b"])


def _print_parts(sizes: dict[int, int], rows: int, reach: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Parts of about ``rows`` texts, from the number of texts of each class: (class, its first part, its parts) and (part, first and last part that its sizes reach)."""
    classes, parts, held = [], [], 0  # a part is its lowest and highest class
    for c in sorted(sizes):
        times = -(-sizes[c] // rows)
        if times > 1 or not parts or held + sizes[c] > rows:
            parts += [[c, c] for _ in range(times)]
            classes.append((c, len(parts) - times, times))
            held = rows if times > 1 else sizes[c]
        else:
            parts[-1][1] = c
            classes.append((c, len(parts) - 1, 1))
            held += sizes[c]
    lowest, highest = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    first, last = np.searchsorted(highest, lowest - reach), np.searchsorted(lowest, highest + reach, "right") - 1
    return classes, [(p, int(first[p]), int(last[p])) for p in range(len(parts))]


def candidate_links(prints: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(a, b): links that connect all texts (key, size, WORDS) whose fingerprints are within the radius and whose sizes allow the similarity.

    The number of texts of each class of sizes passes through the driver. Each pair of parts that may have links is a tile of its own.
    """
    spark = prints.sparkSession
    prints = prints.filter("size > 0").withColumn("class", F.floor(F.log("size") / F.lit(CLASS)))
    sizes = dict(prints.groupBy("class").count().collect())
    rows = min(max(PRINT_ROWS[0], -(-sum(sizes.values()) // PRINT_PARTS)), PRINT_ROWS[1])
    classes, spans = _print_parts(sizes, rows, math.ceil(-math.log(similarity) / CLASS) + 1)
    part_of = spark.createDataFrame(classes, "class bigint, base bigint, times bigint")
    met = spark.createDataFrame(spans, "part bigint, first bigint, last bigint")
    visits = prints.join(F.broadcast(part_of), "class").withColumn("part", F.col("base") + F.pmod(F.xxhash64("key"), F.col("times"))).join(F.broadcast(met), "part")
    visits = visits.withColumn("other", F.explode(F.sequence("first", "last")))
    tile = F.least("part", "other") * F.lit(1 << 32) + F.greatest("part", "other")
    visits = visits.select(tile.alias("tile"), (F.col("part") > F.col("other")).cast("tinyint").alias("role"), "key", "size", *WORDS)

    def close(hosts):
        tile, x = hosts[0].column("tile")[0].as_py(), _Prints(hosts)
        return x, _near(x, x, similarity, radius) if tile >> 32 == tile % (1 << 32) else ()

    def compare(batches):
        return stream_tiles(batches, close, lambda x, batch: _near(x, _Prints([batch]), similarity, radius))

    tiles = sum(last + 1 - part for part, _, last in spans)
    return visits.repartition(min(max(1, tiles), 4096), "tile").sortWithinPartitions("tile", "role").mapInArrow(compare, "a bigint, b bigint")


def key_bits(keys: DataFrame, bits: int) -> np.ndarray:
    """2**bits booleans: is there a key of these last bits. Set on executors; the driver gets 2**bits / 8 bytes at most, whatever the table."""
    place = F.pmod("key", F.lit(1 << bits))
    maps = keys.select(F.floor(place / BITMAP).alias("map"), F.pmod(place, F.lit(BITMAP)).alias("bit")).groupBy("map").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits"))
    out = np.zeros((max(1, (1 << bits) // BITMAP), BITMAP), bool)
    for row in maps.collect():
        out[row["map"]] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
    return out.ravel()[: 1 << bits]


def marked(docs: DataFrame, text_col: str, key: str, only: np.ndarray | None = None, inside: bool = True) -> DataFrame:
    """The rows with the key of their words as column ``key``, last; with ``only`` (of ``key_bits``) just those whose bit is, or is not, set."""
    place = docs.columns.index(text_col)
    shared = None if only is None else docs.sparkSession.sparkContext.broadcast(np.packbits(only))

    def run(batches):
        wanted = None if shared is None else np.unpackbits(shared.value).view(bool) == inside
        for batch in batches:
            keys = np.array([words_key(t or b"") for t in batch.column(place).cast(pa.binary()).to_pylist()], np.int64)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, key])
            yield out if wanted is None else out.filter(pa.array(wanted[keys & (len(wanted) - 1)], pa.bool_()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(key, "long"))


class _Tile:
    """Texts of a tile or block: fingerprints, shingle sets, the group each was known to be in, and is known to be in by now."""

    def __init__(self, batches, similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        self.key, self.known = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("key", "label"))
        texts = [t for b in batches for t in b.column("hashes").to_pylist()]
        hashes = [np.frombuffer(t, np.uint64) for t in texts]
        self.fp = np.array([simhash(h) for h in hashes], np.uint64)
        self.sets = [frozenset(h.tolist()) for h in hashes]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.label = np.unique(self.known, return_inverse=True)[1]

    def similar(self, a: frozenset, b: frozenset) -> bool:
        common = len(a & b)
        return common >= self.similarity * (len(a) + len(b) - common) - 1e-9

    def matches(self, fp, items: frozenset, open_: np.ndarray):
        """One text of each group among the ``open_`` ones, the first of all, that holds a text similar to this one."""
        n, upto = len(items), len(open_)
        size = self.size[:upto]
        open_ = open_ & (np.bitwise_count(self.fp[:upto] ^ fp) <= self.radius)
        open_ &= np.minimum(size, n) >= self.similarity * np.maximum(size, n) - 1e-9
        while True:
            left = np.flatnonzero(open_)
            if not len(left):
                return
            for j in left.tolist():
                if self.similar(items, self.sets[j]):
                    open_ &= self.label[:upto] != self.label[j]
                    yield j
                    break
                open_[j] = False

    def own_links(self) -> list[tuple[int, int]]:
        out = []
        for i in range(1, len(self.key)):
            for j in list(self.matches(self.fp[i], self.sets[i], self.label[:i] != self.label[i])):
                out.append((int(self.key[j]), int(self.key[i])))
                self.label[self.label == self.label[j]] = self.label[i]
        return out


def _verify(similarity: float, radius: int):
    def batch_of(links):
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def close(hosts):
        tile = _Tile(hosts, similarity, radius)
        return tile, batch_of(tile.own_links())

    def visit(tile, batch):
        guests = _Tile([batch], similarity, radius)
        found = ((k, tile.matches(fp, s, tile.known != known)) for k, known, fp, s in zip(guests.key, guests.known, guests.fp, guests.sets))
        return batch_of([(int(tile.key[j]), int(k)) for k, js in found for j in js])

    return lambda batches: stream_tiles(batches, close, visit)


def similar_links(texts: DataFrame, shingle: int, similarity: float, radius: int, tile_rows: int) -> DataFrame:
    """(a, b): links at ``similarity`` or more between each tile's hosts and its hosts and guests, enough of them to connect all that have one.

    Rows are (key, text binary, tiles array of TILE): the tile, its number of texts, the group that the text is known to be in, the tile's number
    of hosts, and whether the text is a host or a guest. A task has about ``tile_rows`` hosts at a time, and GUESTS times as many visit them.
    """

    def hashed(batches):
        for batch in batches:
            hashes = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tiles"), pa.array(hashes, pa.binary())], ["key", "tiles", "hashes"])

    schema = "key bigint, tiles array<struct<tile: bigint, n: bigint, label: bigint, m: bigint, host: boolean, guest: boolean>>, hashes binary"
    rows = texts.select("key", "tiles", "text").mapInArrow(hashed, schema).select("key", "hashes", F.inline("tiles"))
    rows = rows.withColumn("parts", _parts("m", tile_rows)).withColumn("chunks", _parts("n", tile_rows * GUESTS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")))
    stop = lambda part, chunk, role: F.struct(part.alias("part"), chunk.alias("chunk"), F.lit(role).cast("tinyint").alias("role"))
    each = lambda number: F.sequence(F.lit(0).cast("bigint"), F.col(number) - 1)
    hosts = F.transform(F.when(F.col("host"), each("chunks")), lambda chunk: stop(F.col("part"), chunk, 0))
    guests = F.transform(F.when(F.col("guest"), each("parts")), lambda part: stop(part, F.col("chunk"), 1))
    none = F.array().cast("array<struct<part: bigint, chunk: bigint, role: tinyint>>")
    rows = rows.select("tile", "key", "label", "hashes", F.inline(F.concat(F.coalesce(hosts, none), F.coalesce(guests, none))))
    rows = rows.select(F.xxhash64("tile", "part", "chunk").alias("tile"), "role", "key", "label", "hashes")
    return rows.repartition("tile").sortWithinPartitions("tile", "role").mapInArrow(_verify(similarity, radius), "a bigint, b bigint")


def _parts(number: str, rows: int):
    return F.ceil(F.col(number) / F.lit(rows)).cast("bigint")


def _with_sizes(rows: DataFrame, sizes: DataFrame, of: str, hot: int) -> DataFrame:
    """Rows joined with what ``sizes`` tells of their group; groups of over ``hot`` rows, which are few, come by broadcast, so that none makes a large key."""
    large = F.broadcast(sizes.filter(F.col("n") > hot))
    return rows.join(large, of).unionByName(rows.join(large, of, "left_anti").join(sizes.filter(F.col("n") <= hot), of))


def _hot(sizes: DataFrame) -> int:
    return max(HOT_TEXTS, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)


def _tiles(links: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(node, tile, n, large): each candidate's connected group, its number of texts, and whether that is over ``most``."""
    group = scratch.put(connected_components(links, scratch, "candidates").withColumnRenamed("component", "tile"), "groups")
    sizes = scratch.put(group.groupBy("tile").agg(F.count("*").alias("n")), "sizes")
    return _with_sizes(group, sizes, "tile", _hot(sizes)).select("node", "tile", "n", (F.col("n") > most).alias("large"))


def _size_cells(similarity: float):
    """Two cells of a text of ``tile`` by its ``size``: texts whose sizes allow the similarity share one of them."""
    width = 2 * max(-math.log(similarity), 1e-9) * (1 + 1e-6)
    return F.array(*[F.xxhash64("tile", F.lit(grid), F.floor(F.log("size") / F.lit(width) + F.lit(grid / 2))) for grid in (0, 1)])


def _pivots(members: DataFrame, tile_rows: int) -> DataFrame:
    """(node, TILE) of members (node, tile, n, label): all texts meet a fixed share of the tile's, or each other where they are few."""
    host = F.pmod(F.xxhash64("node"), _parts("n", tile_rows)) == 0
    return members.select("node", "tile", "n", "label", F.least("n", F.lit(tile_rows)).cast("bigint").alias("m"), host.alias("host"), (~host).alias("guest"))


def _blocks(members: DataFrame, linked: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, TILE, large) of members (node, tile, n, large) of tiles whose texts are not yet one group: those outside the main group meet all."""
    label = F.coalesce("component", "node").alias("label")
    members = scratch.put(members.join(linked, "node", "left").select("node", "tile", "n", "large", label), f"{tag}labels")
    groups = members.groupBy("tile", "label").agg(F.count("*").alias("texts"))
    tiles = groups.groupBy("tile").agg(F.sum("texts").alias("n"), F.max(F.struct("texts", "label")).alias("main"))
    tiles = tiles.select("tile", "n", F.col("main.label").alias("main"), (F.col("n") - F.col("main.texts")).alias("m"))
    tiles = scratch.put(tiles.filter("m > 0"), f"{tag}tiles")
    rows = _with_sizes(members.drop("n"), tiles, "tile", _hot(tiles))
    return rows.select("node", "tile", "n", "label", "m", (F.col("label") != F.col("main")).alias("host"), F.lit(True).alias("guest"), "large")


def _groups(candidates: DataFrame, sized: DataFrame, links_of, scratch: Scratch, similarity: float, tile_rows: int) -> DataFrame:
    """(node, component) of all candidates with a link; ``links_of`` finds links of rows (node, TILE). ``sized`` has the size of each node."""
    group = scratch.put(_tiles(candidates, scratch, LARGE * tile_rows), "tiles")
    linked = scratch.put(connected_components(links_of(_pivots(group.withColumn("label", F.col("node")), tile_rows)), scratch, "linked"), "first")

    def more(links: DataFrame, tag: str) -> DataFrame:
        links = scratch.put(links, f"{tag}links")
        if links.isEmpty():
            return linked
        return connected_components(links.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch, tag)

    rest = scratch.put(_blocks(group.filter(F.col("n") > tile_rows), linked, scratch, "group"), "rest")
    if rest.isEmpty():
        return linked
    blocks = rest.filter("not large").drop("large")
    large = rest.filter("large")
    if not large.isEmpty():
        celled = large.join(sized, "node").select("node", F.explode(_size_cells(similarity)).alias("tile"), "label", "host")
        celled = scratch.put(celled, "cells")
        open_ = celled.groupBy("tile").agg(F.count("*").alias("n"), F.max("host").alias("open")).filter("open and n > 1").select("tile", "n")
        open_ = scratch.put(open_, "open")
        celled = scratch.put(_with_sizes(celled.drop("host"), open_, "tile", _hot(open_)), "celled")
        linked = scratch.put(more(links_of(_pivots(celled, tile_rows)), "more"), "second")
        wide = celled.filter(F.col("n") > tile_rows).select("node", "tile", "n", F.lit(False).alias("large"))
        blocks = blocks.unionByName(_blocks(wide, linked, scratch, "cell").drop("large"))
    return more(links_of(blocks), "last")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 24, tile_rows: int = 512, bits: int = 24) -> DataFrame:
    """One document of each group linked by ``similarity`` or more: that of the smallest id, in the columns it came with.

    Similarity is the Jaccard coefficient of the sets of ``shingle`` words in a row in lower case, of all words for shorter texts. Texts without words,
    null included, are one group. The id is null only if all of the group are; of rows that share the id and the words one stays.
    ``bits`` only sets how sharply rows are told apart that need not be shuffled.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    signed = scratch.put(_signatures(docs, id_col, text_col, shingle), "signed")
    distinct = scratch.put(signed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("size", *WORDS)]), "distinct")
    scratch.drop("signed")
    candidates = candidate_links(distinct.select("key", "size", *WORDS), similarity, radius)
    sized = distinct.select(F.col("key").alias("node"), "size")
    (key,) = free_names(docs, "words_key")
    turns = count()

    def links_of(members: DataFrame) -> DataFrame:
        tiles = members.groupBy("node").agg(F.collect_list(F.struct(*TILE)).alias("tiles"))  # its group, or a place for each of its cells
        wanted = scratch.put(tiles.join(distinct.select(F.col("key").alias("node"), "least"), "node"), f"wanted{next(turns)}")
        # only texts that may be candidates are shuffled; a set bit without a key costs a row's journey, nothing else
        rows = marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "words_key", key_bits(wanted.select(F.col("node").alias("key")), bits))
        texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["least"]) & (rows["words_key"] == wanted["node"])).dropDuplicates(["node"])
        return similar_links(texts.select(F.col("node").alias("key"), "tiles", text_bytes("text").alias("text")), shingle, similarity, radius, tile_rows)

    linked = _groups(candidates, sized, links_of, scratch, similarity, tile_rows).withColumnRenamed("node", "key")
    member = distinct.select("key", "least", "rows").join(linked, "key", "left")
    member = scratch.put(member.filter("rows > 1 or component is not null").select("key", "least", F.coalesce("component", "key").alias("root")), "member")
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "key")).alias("first")
    kept = scratch.put(member.groupBy("root").agg(first).select(F.col("first.least").alias("kept_id"), F.col("first.key").alias("kept_key")), "kept")
    # rows of texts without a copy stay where they are
    copied = key_bits(member.select("key"), bits)
    alone = marked(docs, text_col, key, copied, inside=False)
    every = marked(docs, text_col, key, copied)
    single = every.join(member.select(F.col("key").alias(key)), key, "left_anti")
    match = every[id_col].eqNullSafe(kept["kept_id"]) & (every[key] == kept["kept_key"])
    chosen = every.join(kept, match, "left_semi").dropDuplicates([id_col, key])
    return alone.unionByName(single).unionByName(chosen).select(*docs.columns)
