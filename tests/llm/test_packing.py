import inspect
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lattica.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [" a", "a ", "", "a  b", "\n", "a\n\nb", "x\ty z", "<|endoftext|> a b", "a <|endoftext|>", "é, ñ. 12, a1. 12.", "a　b c", "a \nb", "tab\t x", '"quoted," she said.', "...", "a .", "\xa0b c", "it's ###, $$$.", "a\r\nb", "naïve.\nÉcole, œuvre", "x\x1cy z", "1,2. 3, a,. b"]


@pytest.fixture(scope="module")
def encoder():
    return packing.PieceEncoder(PATH)


def test_ids_are_the_tokenizers(encoder):
    rng = random.Random(6)
    made = ["".join(rng.choice(["ab", " ", "\n", ",", ".", "É", "12", "#", "  ", "'s", "\t"]) for _ in range(60)) for _ in range(300)]
    for text in ODD + made + ODD:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.full.encode(text, add_special_tokens=False).ids


def test_ids_of_every_text_of_a_table(encoder):
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    want = encoder.full.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(encoder.encode(t), "<u4").tolist() == w.ids for t, w in zip(texts, want))


@pytest.mark.parametrize("text", [" " * 300_000, " " * 300_000 + "a", "a" * 300_000, "x9" * 100_000, "\n" * 100_000 + "b", " \n\t" * 50_000 + "x", "?!" * 100_000])
def test_ids_of_long_runs(encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.full.encode(text, add_special_tokens=False).ids


class PlainBins:
    """Bounded-space best-fit by looking through a list of [free, bin]."""

    def __init__(self, capacity, open_bins):
        self.capacity, self.open_bins, self.bins, self.made, self.closed = capacity, open_bins, [], 0, 0

    def place(self, size):
        fitting = [b for b in self.bins if b[0] >= size]
        if not fitting:
            if len(self.bins) == self.open_bins:
                self.bins.remove(min(self.bins, key=lambda b: b[0]))
                self.closed += 1
            fitting = [[self.capacity, self.made]]
            self.bins += fitting
            self.made += 1
        chosen = min(fitting, key=lambda b: b[0])
        offset = self.capacity - chosen[0]
        chosen[0] -= size
        self.bins = [b for b in self.bins if b[0]]
        return offset


@pytest.mark.parametrize("open_bins", [1, 2, 16, 256])
def test_bins_are_those_of_a_plain_search(open_bins):
    rng = random.Random(7)
    for capacity in (10, 100, 1024):
        fast, plain, content = packing.Bins(capacity, open_bins), PlainBins(capacity, open_bins), {}
        for _ in range(3000):
            size = rng.randrange(1, capacity + 1) if rng.random() < 0.7 else rng.randrange(1, capacity // 4 + 2)
            number, offset = fast.place(size)
            assert offset == plain.place(size) == content.get(number, 0)  # equal free spaces are interchangeable
            content[number] = offset + size
        assert (fast.made, fast.closed, fast.open) == (plain.made, plain.closed, len(plain.bins)) and max(content.values()) <= capacity


def test_the_fullest_closes():
    bins = packing.Bins(10, 2)
    assert [bins.place(s)[0] for s in (6, 7, 8, 3)] == [0, 1, 2, 0] and bins.closed == 1  # opening the third closes the bin of 7


def test_bins_close_at_the_setting_of_the_query(encoder):
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()]
    sizes = [(len(encoder.encode(t)) // 4 + 1) % 1024 for t in texts]
    default = inspect.signature(packing.pack).parameters
    bins = packing.Bins(1024, default["open_bins"].default)
    for size in filter(None, sizes):
        bins.place(size)
    assert bins.closed > 1000 and bins.made <= 1.03 * sum(sizes) / 1024


def check(packed, capacity):
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in bins.values():
        upto = 0
        for offset, length in sorted(rows):
            assert offset == upto
            upto += length
        assert upto <= capacity
    return len(bins)


def test_pieces_and_sequences(spark, odd_docs, no_docs, encoder):
    pieces = packing.tokenize_pieces(odd_docs, PATH)
    rows = pieces.collect()
    empty = [r for r in rows if r.id in (3, 4)]
    assert [(r.piece, r.start, r.length) for r in empty] == [(0, 0, 1), (0, 0, 1)] and all(bytes(r.ids) == b"\x02\0\0\0" for r in empty)
    long = sorted((r for r in rows if r.id == 6), key=lambda r: r.piece)
    text = odd_docs.filter("doc_id = 6").first().text
    assert b"".join(bytes(r.ids) for r in long) == encoder.encode(text) + b"\x02\0\0\0"
    assert all(r.length == 1024 for r in long[1:]) and long[0].length <= 1024
    packed = packing.pack(pieces)
    got = packed.collect()
    assert len(got) == len(rows)
    n = check(got, 1024)
    assert n == -(-sum(r.length for r in rows) // 1024)
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in got:
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.pack(packing.tokenize_pieces(no_docs, PATH)).count() == 0


def test_many_packers_waste_little(spark):
    sizes = spark.range(20_000).select(F.col("id"), F.lit(0).alias("piece"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"), F.lit("kept").alias("packer"))
    got = packing.pack(sizes, pieces_per_packer=4000).collect()
    assert len(got) == 20_000
    assert check(got, 1024) <= 1.03 * sum(r.length for r in got) / 1024
