"""Secret scans, in SQL expressions only.

Base patterns give the spans of assignments, access keys and hexadecimal strings. The entropy scan adds spans:
over each candidate string a window slides a character at a time; counts of its characters are kept up to date by one increment
and one decrement, and with them the window's Shannon entropy, which is held against the threshold of the candidate's character class.
Candidates on the allow-list are left out. Positions count code points; ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, least length of the group that counts, that group.
BASE_PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"(AKIA[A-Z0-9]+)", 20, 1),
    ("hex", r"([0-9a-f]{24,})", 24, 1),
]
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a character, by class of the candidate. Windows of 20 random characters have about 3.2 (hexadecimal) and 4.1 (64 letters).
HEX_BITS, TEXT_BITS = 3.0, 3.7
#: Candidates that look random but are no secrets.
ALLOWED = [
    r"^[A-Za-z]+$",  # words run together
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i)(example|sample|dummy|placeholder|changeme|xxxxx|your[_-])",
]
#: Paths and compounds, also no secrets: letters and joiners, a letter first, but no two joiners in a row.
COMPOUND, JOINERS = r"^[A-Za-z][A-Za-z/_=+-]*$", r"[/_=+-]{2}"
#: Fixed value: the classic alphabet row that test data repeats.
ALLOWED_TEXTS = ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]

_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _matches(text: Column, kind: str, pattern: str, least: int, group: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose counted group is long enough.

    What lies between matches comes from splitting at them; running lengths of both give the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), counted.alias("counted"))
    start = F.struct(F.lit(0).alias("at"), _none().alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.length(p["hit"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(p["counted"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(parts, start, step)["spans"]).otherwise(_none())


#: counts of a window's characters stand in 64-bit numbers, 12 counts of 5 bits each
PER_WORD, COUNT_BITS = 12, 5
WORDS = -(-len(ALPHABET) // PER_WORD)
_XLOG2 = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def _codes(text: Column) -> Column:
    """Each character's count: the number that holds it, from 1, and its lowest bit there."""

    def code(c: Column) -> Column:
        place = F.call_function("locate", c, F.lit(ALPHABET)) - 1
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(PER_WORD)) * COUNT_BITS)
        return F.struct((F.floor(place / PER_WORD) + 1).cast("int").alias("word"), bit.alias("one"))

    return F.transform(F.split(text, ""), code)


def _moves(codes: Column) -> Column:
    """What each step of the window takes in and, a window later, lets out."""
    nothing = F.struct(F.lit(1).alias("word"), F.lit(1).cast("bigint").alias("one"))
    out = F.slice(F.concat(F.array_repeat(nothing, WINDOW), codes), F.lit(1), F.size(codes))
    return F.arrays_zip(codes.alias("in"), out.alias("out"))


def _count(counts: Column, code: Column) -> Column:
    """The count of a character: its number, shifted down to its lowest bit."""
    return F.call_function("div", F.element_at(counts, code["word"]), code["one"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")


def _not_allowed(candidates: Column) -> Column:
    def suspicious(c: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | F.regexp_like(c["text"], F.lit(pattern))
        allowed = allowed | (F.regexp_like(c["text"], F.lit(COMPOUND)) & ~F.regexp_like(c["text"], F.lit(JOINERS)))
        for known in ALLOWED_TEXTS:
            allowed = allowed | c["text"].contains(known)
        return ~allowed

    return F.filter(candidates, suspicious)


def entropy_spans(text: Column) -> Column:
    """Spans of kind "entropy": from the first to the last window of a candidate that exceeds its class's threshold."""
    found = _matches(text, "entropy", CANDIDATE, WINDOW, 1)
    # each step binds what the next uses many times; an expression on the candidate inside the aggregate would be evaluated for every character
    bits_of = lambda c: F.when(F.regexp_like(c, F.lit("^[0-9a-fA-F]+$")), F.lit(HEX_BITS)).otherwise(F.lit(TEXT_BITS))
    cut = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))
    coded = F.transform(_not_allowed(cut), lambda c: F.struct(c["start"].alias("start"), bits_of(c["text"]).alias("bits"), _codes(c["text"]).alias("codes")))
    # what the n-th like character adds to a window's sum of n * log2(n)
    added = F.array(*[F.lit(b - a) for a, b in zip(_XLOG2, _XLOG2[1:])])
    none = F.lit(0).cast("bigint")

    def judged(span: Column) -> Column:
        zero = F.struct(
            F.array_repeat(none, WORDS).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("i"),
            F.lit(-1).alias("first"), F.lit(-1).alias("last"),
        )

        def seen(acc):
            """(first, last) with the window that ends before character i judged."""
            high = (acc["i"] >= WINDOW) & (F.lit(_XLOG2[WINDOW]) - acc["total"] >= span["bits"] * WINDOW - 1e-9)
            at = acc["i"] - WINDOW
            return F.when(high & (acc["first"] < 0), at).otherwise(acc["first"]).alias("first"), F.when(high, at).otherwise(acc["last"]).alias("last")

        def step(acc, move):
            full = acc["i"] >= WINDOW
            new, old = move["in"], move["out"]
            n_in = _count(acc["counts"], new) + F.when(full & (new == old), F.lit(0)).otherwise(F.lit(1))
            lost = F.when(full, F.element_at(added, _count(acc["counts"], old))).otherwise(F.lit(0.0))
            change = lambda k: F.when(k == new["word"], new["one"]).otherwise(none) - F.when(full & (k == old["word"]), old["one"]).otherwise(none)
            counts = F.transform(acc["counts"], lambda c, k: c + change(k + 1))
            return F.struct(counts.alias("counts"), (acc["total"] - lost + F.element_at(added, n_in)).alias("total"), (acc["i"] + 1).alias("i"), *seen(acc))

        best = F.aggregate(_moves(span["codes"]), zero, step, lambda acc: F.struct(*seen(acc)))
        return F.struct(span["start"].alias("at"), best.alias("best"))

    kept = F.filter(F.transform(coded, judged), lambda s: s["best"]["first"] >= 0)
    return F.transform(kept, lambda s: F.struct(F.lit("entropy").alias("kind"), (s["at"] + s["best"]["first"]).alias("start"), (s["at"] + s["best"]["last"] + WINDOW).alias("end")))


_KINDS = [k for k, *_ in BASE_PATTERNS] + ["entropy"]


def _ordered(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, _KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, added): spans as arrays of (kind, start, end), sorted by start, then kind as listed.

    Base spans are all kept; entropy spans that touch a base span add nothing and are left out. Null text is empty. Repeated
    and null ids keep their rows. Texts and candidates may be of any length. Works row by row, without a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.withColumns({f"s{i}": _matches(text, *p) for i, p in enumerate(BASE_PATTERNS)} | {"high": entropy_spans(text)})
    base = F.concat(*[F.col(f"s{i}") for i in range(len(BASE_PATTERNS))])
    rows = rows.withColumn("base", _ordered(base))
    clear = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return rows.select("id", "text", "base", F.filter("high", clear).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def all_spans(base: Column, added: Column) -> Column:
    return _ordered(F.concat(base, added))


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each span (sorted by start; overlaps run together) replaced by a mask."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        gap = F.greatest(s["start"] - acc["at"], F.lit(0))
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, gap), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], piece).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """The documents with every base and entropy span masked, in the columns they came with; ``length_col``, if there, follows.

    Null texts stay null and texts without spans stay as they are.
    """
    names, text = docs.columns, F.coalesce(F.col(text_col), F.lit(""))
    spans, high = "spans", "high"
    while {spans, high} & set(names):  # names of our own
        spans, high = f"_{spans}", f"_{high}"
    base = F.concat(*[_matches(text, *p) for p in BASE_PATTERNS])
    marked = docs.withColumn(high, entropy_spans(text)).withColumn(spans, all_spans(base, F.col(high)))
    changed = F.size(spans) > 0
    out = {text_col: F.when(changed, redact(text, F.col(spans), mask)).otherwise(F.col(text_col))}
    marked = marked.withColumns(out)
    if length_col in names:
        marked = marked.withColumn(length_col, F.when(changed, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return marked.select(*names)
