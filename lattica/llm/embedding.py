"""Embedding near-duplicates by a subspace pigeonhole join on cosine similarity.

Unit vectors at least as similar as the threshold have a squared distance of at most 2 - 2 * threshold. Rotated to
principal axes and split into blocks, such a pair has some block whose squared distance is within that block's
budget, its share of the whole in proportion to the block's variance. Each block is joined by range alone: a
k-d tree over the block's few dimensions gives leaves; a vector is host in its own leaf and visits
other leaves within reach, one direction for each pair of leaves. In a leaf a finer k-d tree over its hosts takes hosts and visitors to
the few cells within reach. The candidates of all blocks are united by counting a pair only in the first
block that finds it, and verified by the cosine of the original components in double precision.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, forest, stream_tiles
from .components import connected_components

SLACK = 1e-5  # on squared distances of single-precision coordinates
PAIRS_AT_ONCE = 8_192
CELL_ROWS = 256  # hosts in a cell of a leaf's own tree
PRODUCTS_AT_ONCE = 1 << 18  # distances that stay in a core's cache
SALTS = 8  # one vector may make up a third of all rows


def _depth(n: int, rows: int) -> int:
    """Levels of halving until at most ``rows`` of n are left."""
    return max(0, int(n - 1) // rows).bit_length() if n > rows else 0


class Halves:
    """A k-d tree. Inner node k splits along axis[k] at at[k] into nodes 2k + 1 (not above) and 2k + 2 (not below); the rest are leaves."""

    def __init__(self, points: np.ndarray, depth: int):
        self.inner = (1 << depth) - 1
        self.axis, self.at = np.zeros(self.inner, np.int64), np.zeros(self.inner, np.float32)
        held = [np.arange(len(points))]
        for k in range(self.inner):
            mine, half = held[k], len(held[k]) // 2
            order = np.arange(len(mine))
            if len(mine):
                self.axis[k] = points[mine].var(axis=0).argmax()
                values = points[mine, self.axis[k]]
                order = np.argpartition(values, half)
                self.at[k] = values[order[half]]
            held += [mine[order[:half]], mine[order[half:]]]
            held[k] = None
        self.held = held[self.inner :]

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(points), np.int64)
        while node.size and node[0] < self.inner:
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - self.inner

    def reach(self, points: np.ndarray, limit: float):
        """(leaf, rows of the points whose squared distance to the leaf's box is within the limit), leaf by leaf."""
        columns = np.ascontiguousarray(points.T)
        open_nodes = [(0, np.arange(len(points)), np.zeros(len(points), np.float32), {})]
        while open_nodes:
            node, rows, square, gaps = open_nodes.pop()
            if not len(rows):
                continue
            if node >= self.inner:
                yield node - self.inner, rows
                continue
            axis = self.axis[node]
            over = columns[axis][rows] - self.at[node]
            before = gaps.get(axis, np.float32(0))
            for child, gap in ((2 * node + 1, over), (2 * node + 2, -over)):
                gap = np.maximum(gap, before)
                further = square + (gap * gap - before * before)
                keep = np.flatnonzero(further <= limit)
                open_nodes.append((child, rows[keep], further[keep], {k: v[keep] for k, v in gaps.items()} | {axis: gap[keep]}))


class Blocks:
    """Rotation, blocks, budgets and trees; the size depends on the sample and the parameters alone."""

    def __init__(self, sample: np.ndarray, threshold: float, n_blocks: int, depth: int):
        unit = _unit(sample)
        dims = unit.shape[1]
        _, axes = np.linalg.eigh(unit.T @ unit)
        self.rotation = np.ascontiguousarray(axes[:, ::-1])
        self.single = self.rotation.astype(np.float32)
        self.threshold = threshold
        self.cuts = [c for c in np.array_split(np.arange(dims), min(n_blocks, dims))]
        rotated = unit @ self.rotation
        spread = np.array([rotated[:, c].var(axis=0).sum() for c in self.cuts]) + 1e-12
        self.budget = (2 - 2 * threshold) * spread / spread.sum()
        self.trees = [Halves(rotated[:, c].astype(np.float32), depth) for c in self.cuts]
        for tree in self.trees:
            tree.held = None
        self.leaves = 1 << depth

    def first_block(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of the first block within its budget, from unit vectors; the same for a pair wherever it is asked."""
        delta = x - y
        rotated = np.stack([(delta * self.rotation[:, k]).sum(axis=1) for k in range(self.rotation.shape[1])], axis=1)
        square = rotated * rotated
        within = np.stack([square[:, c].sum(axis=1) <= self.budget[i] + SLACK / 2 for i, c in enumerate(self.cuts)], axis=1)
        return np.where(within.any(axis=1), within.argmax(axis=1), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def keyed_vectors(rows: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, size, key, vec): components as bytes and a digest of them; size, key and vec null where nothing can be linked."""

    def run(batches):
        for batch in batches:
            keys, vecs, sizes = [], [], []
            for value in batch.column("v"):
                x = None
                if value.is_valid and len(value) and value.values.null_count == 0:
                    x = value.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # no negative zeros
                if x is None or not np.isfinite(x).all() or not x.any():
                    keys.append(None), vecs.append(None), sizes.append(None)
                else:
                    raw = x.astype(kind).tobytes()
                    keys.append(hashlib.blake2b(raw, digest_size=16).digest()), vecs.append(raw), sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["id", "size", "key", "vec"])

    schema = f"id {rows.schema[id_col].dataType.simpleString()}, size int, key binary, vec binary"
    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, schema)


def _visits(guest, host):
    """Of two different leaves, or parts of one, exactly one visits the other; by parity, so that none is visited by all."""
    return ((host < guest) ^ ((host + guest) % 2 == 1)) & (host != guest)


def _deal(blocks: Blocks, kind: str, parts: np.ndarray | None):
    """Host and visitor rows by tile; with ``parts`` None only (tile, count) of the hosts."""

    def run(batches):
        for part in batches:
            if not part.num_rows:
                continue
            rotated = (_unit(_vectors(part.column("vec"), kind)) @ blocks.rotation).astype(np.float32)
            uid = part.column("uid").to_numpy()
            for b, (cut, tree) in enumerate(zip(blocks.cuts, blocks.trees)):
                points = rotated[:, cut]
                home = tree.home(points)
                if parts is None:
                    tile, n = np.unique(home, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b * blocks.leaves + tile), pa.array(n)], ["tile", "n"])
                    continue
                own = uid % np.maximum(parts[b, home], 1)
                yield from rows_of(part, np.arange(len(uid)), b * blocks.leaves + home, own, 0)
                for leaf, rows in tree.reach(points, blocks.budget[b] + SLACK):
                    rows = rows[(home[rows] == leaf) | _visits(home[rows], leaf)]
                    for chunk in range(parts[b, leaf]):
                        guests = rows[(home[rows] != leaf) | _visits(own[rows], chunk)]
                        yield from rows_of(part, guests, np.full(len(guests), b * blocks.leaves + leaf), np.full(len(guests), chunk), 1)

    def rows_of(part, rows, leaf, chunk, role):
        for k in range(0, len(rows), 8192):
            s = slice(k, k + 8192)
            pick = pa.array(rows[s])
            arrays = [pa.array(leaf[s] << 20 | chunk[s]), pa.array(np.full(len(pick), role, np.int8))]
            yield pa.RecordBatch.from_arrays(arrays + [part.column(c).take(pick) for c in ("uid", "weight", "vec")], ["tile", "role", "uid", "weight", "vec"])

    return run


class _Tile:
    def __init__(self, blocks: Blocks, kind: str, batches):
        self.b = int(batches[0].column("tile")[0].as_py() >> 20) // blocks.leaves
        self.uid = np.concatenate([b.column("uid").to_numpy() for b in batches])
        self.weight = np.concatenate([b.column("weight").to_numpy() for b in batches])
        self.unit = _unit(np.concatenate([_vectors(b.column("vec"), kind) for b in batches]))
        self.cut = (self.unit.astype(np.float32) @ blocks.single[:, blocks.cuts[self.b]]).astype(np.float32)
        square = (self.cut * self.cut).sum(axis=1, keepdims=True)
        self.left = np.hstack([self.cut, square, np.ones_like(square)])
        self.right = np.hstack([-2 * self.cut, np.ones_like(square), square])  # left @ right.T: squared distances

    def cells(self) -> _Tile:
        """Rows in the order of the cells of a tree; cell k holds those from ends[k] to ends[k + 1]."""
        self.tree = Halves(self.cut, _depth(len(self.uid), CELL_ROWS))
        order, self.ends = np.concatenate(self.tree.held), np.cumsum([0, *map(len, self.tree.held)])
        for name in ("uid", "weight", "unit", "cut", "left", "right"):
            setattr(self, name, getattr(self, name)[order])
        return self


def _true_places(marks: np.ndarray) -> np.ndarray:
    """Places of the few true marks, found eight at a time."""
    whole = len(marks) // 8 * 8
    some = np.flatnonzero(marks[:whole].view(np.uint64))
    places = (some[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([places[marks[places]], whole + np.flatnonzero(marks[whole:])])


def _within(x: _Tile, y: _Tile, limit: np.float32):
    """Pairs (row of x, row of y) within the limit in the tile's block; with x the same as y each pair once. x has cells."""
    for cell, rows in x.tree.reach(y.cut, limit):
        start, end = x.ends[cell : cell + 2]
        if x is y:
            rows = rows[rows < end]
        n, right = end - start, x.right[start:end].T
        step = max(1, PRODUCTS_AT_ONCE // max(1, n))
        for at in range(0, len(rows) if n else 0, step):
            guests = rows[at : at + step]
            near = _true_places((y.left[guests] @ right).ravel() <= limit)
            i, j = start + near % n, guests[near // n]
            if x is y:
                i, j = i[j < i], j[j < i]
            yield i, j


def _blocks_of(pairs, size: int):
    """The pairs again, at most ``size`` at a time and seldom fewer."""
    held, n = [], 0
    for pair in pairs:
        for at in range(0, len(pair[0]), size):
            held.append((pair[0][at : at + size], pair[1][at : at + size]))
            n += len(held[-1][0])
            if n >= size:
                i, j = map(np.concatenate, zip(*held))
                yield i[:size], j[:size]
                held, n = [(i[size:], j[size:])], n - size
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def _join(blocks: Blocks, kind: str):
    def links(x: _Tile, y: _Tile):
        """Rows of link counts for both sides, and a spanning forest of the links found."""
        count_x, count_y = np.zeros(len(x.uid), np.int64), np.zeros(len(y.uid), np.int64)
        label = np.arange(len(x.uid) + (0 if x is y else len(y.uid)))
        for i, j in _blocks_of(_within(x, y, np.float32(blocks.budget[x.b] + SLACK)), PAIRS_AT_ONCE):
            close = (x.unit[i] * y.unit[j]).sum(axis=1) >= blocks.threshold
            i, j = i[close], j[close]
            first = blocks.first_block(x.unit[i], y.unit[j]) == x.b
            i, j = i[first], j[first]
            np.add.at(count_x, i, y.weight[j])
            np.add.at(count_y, j, x.weight[i])
            child = np.flatnonzero(label != np.arange(len(label)))
            other = j + (0 if x is y else len(x.uid))
            if len(i):
                label = forest(len(label), np.concatenate([child, i]), np.concatenate([label[child], other]))
        if x is y:
            count_x, count_y = count_x + count_y, count_y[:0]
        uid, count = np.concatenate([x.uid, y.uid[: len(count_y)]]), np.concatenate([count_x, count_y])
        some = np.flatnonzero(count)
        if not len(some):
            return
        yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.nulls(len(some), pa.int64()), pa.array(count[some])], ["a", "b", "n"])
        child = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(uid[child]), pa.array(uid[label[child]]), pa.nulls(len(child), pa.int64())], ["a", "b", "n"])

    def close(batches):
        tile = _Tile(blocks, kind, batches).cells()
        return tile, links(tile, tile)

    def visit(tile, batch):
        return links(tile, _Tile(blocks, kind, [batch]))

    return lambda batches: stream_tiles(batches, close, visit)


def _links(distinct: DataFrame, n: int, kind: str, threshold: float, n_blocks: int, sample_rows: int, leaf_rows: int) -> DataFrame:
    depth = min(_depth(n, leaf_rows), _depth(sample_rows, 16))
    sample = distinct.select("uid", "vec").orderBy(F.xxhash64("uid"), "uid").limit(min(sample_rows, max(4096, 16 << depth))).collect()
    blocks = Blocks(np.stack([np.frombuffer(r["vec"], kind) for r in sample]), threshold, n_blocks, depth)
    sizes = distinct.select("uid", "vec").mapInArrow(_deal(blocks, kind, None), "tile bigint, n bigint").groupBy("tile").agg(F.sum("n")).collect()
    parts = np.zeros(len(blocks.cuts) * blocks.leaves, np.int64)
    for tile, hosts in sizes:
        parts[tile] = -(-hosts // (2 * leaf_rows))
    dealt = distinct.mapInArrow(_deal(blocks, kind, parts.reshape(len(blocks.cuts), -1)), "tile bigint, role tinyint, uid bigint, weight bigint, vec binary")
    return dealt.repartition("tile").sortWithinPartitions("tile", "role").mapInArrow(_join(blocks, kind), "a bigint, b bigint, n bigint")


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", n_blocks: int = 8, sample_rows: int = 65_536, leaf_values: int = 1 << 21) -> DataFrame:
    """(id, n_links, component, kept): the vectors within the cosine threshold of each, and the smallest id reachable.

    Exact at any size: the sample (4,096 vectors, or 16 for each leaf, at most ``sample_rows``) shapes the rotation and the leaves, not the
    result. A leaf is to hold ``leaf_values`` components; one of over twice as many is cut into parts. Equal vectors are
    compared once and counted as often as they occur. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different lengths do not link.
    Repeated ids keep their rows. An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "pigeonhole")
    kind = "<f4" if rows.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    keyed = scratch.put(keyed_vectors(rows, id_col, vector_col, kind), "keyed")
    distinct = keyed.filter("key is not null").groupBy("size", "key").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    distinct = scratch.put(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    sizes = distinct.groupBy("size").count().orderBy("size").collect()
    found = None
    for size, n in sizes:
        part = distinct.filter(F.col("size") == size).select("uid", "weight", "vec")
        links = scratch.put(_links(part, n, kind, threshold, n_blocks, sample_rows, max(1, leaf_values // size)), f"links{size}")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    counts = found.filter("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("links"))
    linked = connected_components(found.filter("b is not null").select("a", "b"), scratch).withColumnRenamed("node", "uid")
    member = distinct.drop("vec").join(counts, "uid", "left").join(linked, "uid", "left").withColumn("root", F.coalesce("component", "uid"))
    smallest = member.groupBy("root").agg(F.min("least").alias("smallest"))
    judged = member.join(smallest, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "smallest")
    judged = scratch.put(judged, "judged").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = keyed.select("id", "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(judged, ["key", "salt"], "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return out.select("id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))
