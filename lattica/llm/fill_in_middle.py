"""Fill-in-the-middle: a document is cut at two places between its lines and its parts are reordered around sentinels.

Cuts are found for all rows of a batch together, on the bytes of the Arrow column: a lookup gives each byte's class, a mask marks the
bytes at which a line begins (one after a line break, or the first of a document), its running sum less that at the document's start
numbers the lines, and a binary search in that sum turns line numbers into bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import text_bytes

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle
SLICE = 4 << 20  # bytes of text cut together; a longer text makes a slice of its own
_NEWLINE, _INSIDE = 1, 2
#: Per byte: a line break, a byte inside a character, or any other.
_CLASS = np.array([_NEWLINE if b == 0x0A else _INSIDE if 0x80 <= b <= 0xBF else 0 for b in range(256)], np.uint8)
FORMS = np.array(["plain", "psm", "spm"])


def find_cuts(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, other: np.ndarray):
    """(lines, first cut, second cut, code points of prefix, of middle) of documents that lie gapless in ``data`` from offset to offset.

    A document of n lines is cut after ``one`` % (n + 1) and ``other`` % (n + 1) of them, the smaller first.
    """
    kinds = _CLASS[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = kinds[:-1] == _NEWLINE
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    lines = np.cumsum(begins, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    before = np.zeros(len(offsets), np.int64)
    before[offsets > 0] = lines[offsets[offsets > 0] - 1]
    n = np.diff(before)
    # the line after the last is the next document's first, which begins where this one ends
    cut = [np.searchsorted(lines, (before[:-1] + k % (n + 1) + 1).astype(lines.dtype)) for k in (one, other)]
    first, second = np.minimum(*cut), np.maximum(*cut)
    edges = np.column_stack([offsets[:-1], first, second, offsets[1:]])
    sizes = np.diff(edges, axis=1)
    some = sizes > 0
    chars = np.zeros(sizes.shape, np.int64)
    if some.any():
        chars[some] = np.add.reduceat(kinds != _INSIDE, edges[:, :3][some], dtype=np.int64)
    return n, first, second, chars[:, 0], chars[:, 1]


def _rewrite(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray, marks: tuple[bytes, ...]) -> pa.Array:
    """The reordered texts as a column."""
    view, parts, (p, s, m) = memoryview(data), [], marks
    for a, b, c, d, kind in zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), form.tolist()):
        if kind == 0:
            parts.append(view[a:d])
        elif kind == 1:
            parts += (p, view[a:b], s, view[c:d], m, view[b:c])
        else:
            parts += (s, view[c:d], p, view[a:b], m, view[b:c])
    sizes = np.diff(offsets) + (form > 0) * sum(map(len, marks))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(form), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])


def _slices(offsets: np.ndarray):
    """Ranges of rows of about ``SLICE`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, end
        at = end


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every document.

    The four first groups of eight hex digits of the SHA-256 of seed and id, h1 to h4, decide: cuts after h1 % (n + 1) and h2 % (n + 1) of
    the n lines, whether the document is left "plain" (h3 % 100 >= ``percent``), and of the others whether the suffix ("spm") or the
    prefix ("psm") comes first. A null or empty text, and one that holds a sentinel, is plain: output is the text, null as empty, and its
    counts of prefix and middle are null. Any part may be empty. Rows with the same id are cut by the same numbers, a null id counts as an
    empty one. Whole texts of any length are cut. An empty table gives no rows; other columns are not read.
    """
    _check(sentinels)
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    plain = (text == "") | (h[2] % 100 >= percent)
    for mark in sentinels:
        plain = plain | F.contains(text, F.lit(mark))
    kind = F.when(plain, 0).when(h[3] % 100 < spm_percent, 2).otherwise(1).cast("byte")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), h[0].alias("one"), h[1].alias("other"), kind.alias("kind"), text_bytes(f"`{text_col}`").alias("text"))
    marks = tuple(m.encode() for m in sentinels)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            if not len(texts):
                continue
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            one, other, kind = (batch.column(c).to_numpy() for c in ("one", "other", "kind"))
            for a, b in _slices(ends):
                part, offsets = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                n, first, second, prefix, middle = find_cuts(part, offsets, one[a:b], other[a:b])
                hidden = kind[a:b] == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a), pa.array(n), pa.array(FORMS[kind[a:b]]), pa.array(prefix, mask=hidden), pa.array(middle, mask=hidden),
                        _rewrite(part, offsets, first, second, kind[a:b], marks).cast(pa.string()),
                    ],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    schema = StructType().add("id", rows.schema["id"].dataType).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``transform`` made an output of."""
    _check(sentinels)
    parts = F.split(output, "|".join(map(re.escape, sentinels)))  # nothing, two parts, the middle
    one, other, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, middle, other)).when(form == "spm", F.concat(other, middle, one)).otherwise(output)


def _check(sentinels: tuple[str, ...]) -> None:
    """A sentinel's first character stands nowhere else in any of them, so none can begin in a text and end in a sentinel or the reverse."""
    if len(set(sentinels)) != 3 or not all(sentinels) or any(s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("three different sentinels are needed whose first characters stand only at their beginning")
