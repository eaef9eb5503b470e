"""Packing token pieces into fixed-length sequences: bounded-space online best-fit.

Documents are tokenised where they lie; only piece lengths are dealt out for packing. Each packer keeps a fixed
number of open bins. Their free spaces are bits of one integer, so the tightest bin that still takes a piece is
the lowest set bit at or above its length; when a new bin is needed and all are open, the fullest closes first.
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

WHITE_RUN = 10_000  # white-space characters in a row from which a text goes through the full tokenizer


#: The split pattern of byte-level BPE vocabularies of this kind, and the bytes they show as themselves.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary keyed by the bytes its entries stand for; an entry's id is its merge rank."""
    hidden = [b for b in range(256) if b not in SHOWN_BYTES]
    byte_of = {chr(b): b for b in SHOWN_BYTES} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte_of[c] for c in word): i for word, i in vocab.items()}


class PieceEncoder:
    """Byte-level BPE ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary file is read by ``tokenizers``; its ranks and split pattern run in the faster ``tiktoken``, which gives the
    same ids. Texts with special-token strings, and those with white-space runs so long that the pattern would
    exhaust its stack, are encoded by the full tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.full.get_added_tokens_decoder().items()}
        self.special = list(special)
        vocab = {w: i for w, i in self.full.get_vocab(with_added_tokens=False).items() if w not in special}
        self.plain = tiktoken.Encoding("plain", pat_str=SPLIT_PATTERN, mergeable_ranks=byte_ranks(vocab), special_tokens={})
        self.white_run = re.compile(rf"\s{{{WHITE_RUN}}}")

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or (len(text) >= WHITE_RUN and self.white_run.search(text)):
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        return array("I", ids).tobytes()


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids binary): each document's ids, then ``end_id``, cut only if over the capacity.

    A longer document is cut into pieces of the capacity of which the first may be shorter. ``tokenizer`` is the path
    of a vocabulary file that every worker can read. Null text is empty: one piece with the end id alone.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary"

    def run(batches):
        encoder = PieceEncoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256).to_pylist()
                which, piece, start, length, ids = [], [], [], [], []
                for i, text in enumerate(part):
                    body = encoder.encode(text) + end
                    n = len(body) // 4
                    cut, k = 0, 0
                    upto = n % capacity or capacity
                    while cut < n:
                        which.append(at + i)
                        piece.append(k)
                        start.append(cut)
                        length.append(upto - cut)
                        ids.append(body[4 * cut : 4 * upto])
                        cut, upto, k = upto, upto + capacity, k + 1
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


class Bins:
    """Bounded-space best-fit: at most ``open_bins`` bins are open; free spaces are bits of one integer.

    A piece goes to the tightest open bin that takes it. If none does, a new bin is opened, and if all allowed are open the fullest
    closes first. ``made`` and ``closed`` count bins opened and bins closed with space left.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = self.closed = 0

    def _take(self, room: int) -> int:
        number = self.stacks[room].pop()
        if not self.stacks[room]:
            self.free ^= 1 << room
        self.open -= 1
        return number

    def _put(self, room: int, number: int) -> None:
        self.stacks[room].append(number)
        self.free |= 1 << room
        self.open += 1

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of the next piece, of 1 to ``capacity`` tokens."""
        fits = self.free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.open == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
                self.closed += 1
            room, number = self.capacity, self.made
            self.made += 1
        if room > size:
            self._put(room - size, number)
        return number, self.capacity - room


def pack(pieces: DataFrame, capacity: int = 1024, open_bins: int = 256, pieces_per_packer: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to a table with id, piece and length (1 to the capacity).

    Full pieces are sequences of their own. The others go to independent packers, dealt by hash, as many as the table's size asks
    for, about ``pieces_per_packer`` pieces each. A packer streams its pieces in the order of the table's rows and holds only its open bins. Offsets are
    gapless from 0 in each sequence. Repeated ids keep all their pieces; null ids are rows like others. An empty table gives no rows. Columns of the
    names used here (row, packer, sequence_id, offset) are replaced. The input is written to the shared folder first, and packers sort by row, so a lost
    executor repeats the same packing.
    """
    scratch = Scratch(pieces.sparkSession, "pack")
    kept = scratch.put(pieces.drop("sequence_id", "offset", "packer").withColumn("row", F.monotonically_increasing_id()), "pieces")
    part = kept.filter(F.col("length") < capacity)
    packers = max(1, -(-part.count() // pieces_per_packer))
    dealt = part.withColumn("packer", F.pmod(F.xxhash64("row", F.lit(11)), F.lit(packers)))
    names = dealt.columns

    def run(batches):
        packer, bins = None, None
        for batch in batches:
            where, offset = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            owners = batch.column(names.index("packer")).to_pylist()
            for i, (owner, size) in enumerate(zip(owners, batch.column(names.index("length")).to_pylist())):
                if owner != packer:
                    packer, bins = owner, Bins(capacity, open_bins)
                number, offset[i] = bins.place(size)
                where[i] = (number * packers + packer) * 2 + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = StructType([*dealt.schema.fields]).add("sequence_id", "long").add("offset", "long")
    packed = dealt.repartition("packer").sortWithinPartitions("packer", "row").mapInArrow(run, schema).drop("packer")
    full = kept.filter(F.col("length") >= capacity).withColumn("sequence_id", F.col("row") * 2).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.unionByName(full).drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids binary): the packed sequences themselves, from pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # a sequence holds no more than its capacity of tokens
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
