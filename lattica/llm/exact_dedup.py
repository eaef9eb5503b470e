"""Exact duplicates by 128-bit content hash, with a comparison of bytes inside each group. DataFrame functions only.

One pass signs every text: its hash, its length and a digest. Groups are aggregates over these signatures, so only those cross the
network, and a group that holds a third of all rows is combined before it does. A second pass reads the texts whose hash occurs more than
once and groups them by hash and full text: a hash with two texts is a collision, and its rows are grouped by their texts instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: What is deleted from a text before it is compared.
BLANKS = r"[\x20\x09-\x0D]"
#: Up to so many hashes are broadcast (16 bytes each); beyond, rows are matched by a shuffle.
BROADCAST_HASHES = 500_000
#: A group over this share of all rows, and over so many rows, is joined by broadcast; fewer than one over the share can exist.
HOT_SHARE, HOT_ROWS = 1024, 1000


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _best() -> Column:
    """Of a group: the longest original, then the smallest id (null last), then the first row."""
    return F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row"))


def _grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), _best().alias("best"))


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_HASHES else rows


def _joined(rows: DataFrame, groups: DataFrame, by: list[str], n_rows: int, kind: str) -> DataFrame:
    """Rows with their group. Groups too large for one task, of which there are few by their size, are met by broadcast."""
    hot = F.col("n") > max(HOT_ROWS, n_rows // HOT_SHARE)
    large = F.broadcast(groups.filter(hot))
    return rows.join(large, by).unionByName(rows.join(large, by, "left_anti").join(groups.filter(~hot), by, kind))


def _signed(docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column], *others: Column) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.length(text).cast("long").alias("chars"), F.regexp_replace(text, BLANKS, "").alias("norm"), *others)
    return rows.withColumn("hash", content_hash(F.col("norm")))


def _classes(docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column], scratch: Scratch, *others: Column) -> DataFrame:
    """(id, row, hash, digest, others..., n, best) of every row, n and best null where no other text is equal."""
    texts = _signed(docs, id_col, text_col, content_hash, *others)
    names = [c for c in texts.columns if c not in ("id", "chars", "norm", "hash")]
    digest, row = F.unhex(F.sha2("norm", 256)).alias("digest"), F.monotonically_increasing_id().alias("row")
    signed = scratch.put(texts.select("id", "chars", "hash", digest, row, *names), "signed")
    groups = scratch.put(_grouped(signed, ["hash"]).filter("n > 1"), "groups")
    n_rows, n_groups = signed.count(), groups.count()
    repeated = texts.select("hash", "norm").join(_small(groups.select("hash"), n_groups), "hash", "left_semi")
    collided = scratch.put(repeated.groupBy("hash", "norm").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("texts")).filter("texts > 1").select("hash"), "collided")
    n_collided = collided.count()
    if not n_collided:
        return _joined(signed, groups, ["hash"], n_rows, "left")
    apart = scratch.put(texts.join(_small(collided, n_collided), "hash", "left_semi").select("id", "chars", "norm", "hash", digest, row, *names), "apart")
    by_text = _joined(apart, scratch.put(_grouped(apart, ["norm"]), "by_text"), ["norm"], n_rows, "inner").drop("norm")
    rest = _joined(signed.join(_small(collided, n_collided), "hash", "left_anti"), groups.join(_small(collided, n_collided), "hash", "left_anti"), ["hash"], n_rows, "left")
    return rest.unionByName(by_text)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when they are identical without blanks; null counts as empty, and all texts of blanks alone are equal. Of equal texts
    the longest original stays, then that of the smallest id, a null id last; of rows that are repeated with the same id just one is
    ``kept``. The digest is that of the text without blanks. An empty table gives no rows. Other columns are not read. Rows that share a
    hash but not their text are told apart, so any ``content_hash`` gives the same result.
    """
    found = _classes(docs, id_col, text_col, content_hash, Scratch(docs.sparkSession, "exact-dedup"))
    alone = F.col("n").isNull()
    return found.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One document of each group of equal texts, as in ``duplicates``, in the columns it came with; the documents are stored once on the way."""
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole")
    found = _classes(docs, id_col, text_col, content_hash, Scratch(docs.sparkSession, "exact-dedup"), whole)
    kept = found.filter(F.col("n").isNull() | (F.col("best.row") == F.col("row")))
    return kept.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])
