"""Counts of a work per number, as arrays: a row for each work instead of one for each count, where a work's counts must meet many rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the numbers that one list covers; a list has no more entries than that.
LIST_BITS = 12


def narrowest(highest: int) -> str:
    """The smallest integer type that holds numbers up to ``highest``."""
    return next((kind for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)) if highest < 1 << bits), "bigint")


def count_lists(rows: DataFrame, parts: int) -> DataFrame:
    """(ref, of, near, far, small, large) from rows (ref, own: a number or an array of them): how often a ref has a number, in ascending order of it.

    A list covers 4,096 numbers: ``of`` has their higher bits, ``near`` the lower ones, or ``far`` if one is over 127. Counts are in ``small``, or in ``large`` if one is over 127.
    """
    ref = rows.schema["ref"].dataType
    schema = T.StructType().add("ref", ref).add("of", "long")
    for name, kind in (("near", T.ByteType()), ("far", T.ShortType()), ("small", T.ByteType()), ("large", T.LongType())):
        schema = schema.add(name, T.ArrayType(kind))
    rows = rows.select("ref", "own").filter("ref is not null").repartition(parts, "ref").sortWithinPartitions("ref")
    return rows.mapInArrow(lister(LIST_BITS), schema)


def single_counts(counts: DataFrame) -> DataFrame:
    """The same columns from rows (ref, n): the counts of the number 0."""
    small = F.when(F.col("n") < 128, F.array(F.col("n").cast("tinyint")))
    return counts.select("ref", F.lit(0).cast("long").alias("of"), F.array(F.lit(0).cast("byte")).alias("near"), F.lit(None).cast("array<smallint>").alias("far"), small.alias("small"), F.when(F.col("n") >= 128, F.array("n")).alias("large"))


def each_count(rows: DataFrame) -> DataFrame:
    """A row for each count of rows with the columns of ``count_lists``: __p (the number) and n take their place."""
    others = [c for c in rows.columns if c not in ("of", "near", "far", "small", "large")]
    each = rows.select(*others, "of", "small", "large", F.posexplode(F.coalesce(F.col("near").cast("array<smallint>"), F.col("far"))).alias("at", "place"))
    n = F.coalesce(F.get("small", F.col("at")).cast("long"), F.get("large", F.col("at")))
    return each.select(*others, (F.shiftleft("of", LIST_BITS) + F.col("place")).alias("__p"), n.alias("n"))


def slim(rows: DataFrame, name: str) -> DataFrame:
    """The rows with a column of arrays of longs as ``slim``, of ints, where these hold them all, and else as ``wide``; other arrays stay as ``wide``."""
    whole, out = F.col(name), rows.drop(name)
    if rows.schema[name].dataType.elementType != T.LongType():
        return rows.select(*out.columns, F.lit(None).cast("array<int>").alias("slim"), whole.alias("wide"))
    fits = (F.array_min(whole) >= 0) & (F.array_max(whole) < 1 << 31)
    return rows.select(*out.columns, F.when(fits, whole.cast("array<int>")).alias("slim"), F.when(~F.coalesce(fits, F.lit(False)), whole).alias("wide"))


def unslim(rows: DataFrame) -> Column:
    """The arrays of ``slim``."""
    return F.coalesce(F.col("slim").cast(rows.schema["wide"].dataType.simpleString()), F.col("wide"))


def lister(bits: int):
    """From batches (ref, own) in order of ref to those of lists that cover so many bits; all within it, as tasks get it whole."""

    def listed(refs: pa.Array, at: np.ndarray, numbers: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Lists of numbers and counts that are sorted by place of the ref (``at``) and number."""
        of, places = numbers >> bits, numbers & ((1 << bits) - 1)
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
        offsets = pa.array(np.concatenate([starts, [len(n)]]), pa.int32())
        lists = []
        for values, wide in ((places, np.int16), (n, np.int64)):
            over = np.maximum.reduceat(values, starts) > 127
            lists += [pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind)), mask=pa.array(null)) for kind, null in ((np.int8, over), (wide, ~over))]
        return pa.RecordBatch.from_arrays([refs.take(pa.array(at[starts])), pa.array(of[starts], pa.int64()), *lists], ["ref", "of", "near", "far", "small", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the counts of the last ref so far are held until another follows
        held = None  # (ref as an array of one, numbers, counts)
        for batch in batches:
            ref, own = batch.column(0), batch.column(1)
            if not len(ref):
                continue
            new = np.ones(len(ref), dtype=bool)
            new[1:] = pc.not_equal(ref[1:], ref[:-1]).to_numpy(zero_copy_only=False)
            place = np.cumsum(new) - 1
            if pa.types.is_list(own.type):
                place, own = np.repeat(place, pc.list_value_length(own).to_numpy(zero_copy_only=False)), own.flatten()
            # a ref's place in the batch above the 48 bits of a number
            keys, n = np.unique((place << 48) | own.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            refs, at, numbers = ref.filter(pa.array(new)), keys >> 48, keys & ((1 << 48) - 1)
            if held is not None:
                if held[0][0] == refs[0]:
                    first = int(np.searchsorted(at, 1))
                    both, where = np.unique(np.concatenate([held[1], numbers[:first]]), return_inverse=True)
                    sums = np.zeros(len(both), dtype=np.int64)
                    np.add.at(sums, where, np.concatenate([held[2], n[:first]]))
                    at, numbers, n = np.concatenate([np.zeros(len(both), dtype=np.int64), at[first:]]), np.concatenate([both, numbers[first:]]), np.concatenate([sums, n[first:]])
                else:
                    yield listed(held[0], np.zeros(len(held[1]), dtype=np.int64), held[1], held[2])
            last = int(np.searchsorted(at, len(refs) - 1))
            if last:
                yield listed(refs, at[:last], numbers[:last], n[:last])
            held = refs[-1:], numbers[last:], n[last:]
        if held is not None:
            yield listed(held[0], np.zeros(len(held[1]), dtype=np.int64), held[1], held[2])

    return run
