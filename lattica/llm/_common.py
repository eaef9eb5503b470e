"""Shared pieces of the text-corpus operators: scratch tables, tile streaming, small numpy helpers."""

from __future__ import annotations

import gc
import time

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor re-reads them, not their ancestors. They go with the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_folder(spark, name)

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def release(self) -> None:
        """Let Spark delete the shuffle files of frames that are no longer referred to; tables written here are not touched."""
        for _ in range(2):  # the first round lets go of Python's references, the second of what they held
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, tag: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(tag))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all lowest bytes first."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(value, kind) -> np.ndarray:
    """The numbers in an Arrow scalar made by ``packed``."""
    planes = np.frombuffer(zstandard.decompress(value.as_buffer()), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def text_bytes(col: str):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of the connected component of each of n nodes, given links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    while (label != label[label]).any():
        label = label[label]
    return label


def stream_tiles(batches, close, visit):
    """Feed rows sorted by (tile, role) to numpy, one tile at a time.

    Rows of role 0 are the tile's hosts (few: the caller bounds them); ``close(list of RecordBatch)``
    returns (state, outputs) once they are complete. Rows of role 1 visit the tile and may be any number:
    ``visit(state, RecordBatch)`` gets them a batch at a time and yields outputs.
    """
    current, hosts, state = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column("tile").to_numpy()
        role = batch.column("role").to_numpy()
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1), len(tile)]
        for start, end in zip(cuts, cuts[1:]):
            if tile[start] != current:
                if hosts and state is None:
                    yield from close(hosts)[1]
                current, hosts, state = tile[start], [], None
            n = int((role[start:end] == 0).sum())
            if n:
                hosts.append(batch.slice(start, n))
            if n < end - start and hosts:
                if state is None:
                    state, out = close(hosts)
                    yield from out
                yield from visit(state, batch.slice(start + n, end - start - n))
    if hosts and state is None:
        yield from close(hosts)[1]
