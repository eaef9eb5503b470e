"""Scalar expressions over ids, years, names and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the plain letters that stand for them.
ACCENTED = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľŀłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijklllllnnnnooooooooorrrssssstttuuuuuuuuuuwyyyzzz"
#: Letters that become two.
DOUBLED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}

MAX_LETTERS, MAX_WORDS = 256, 32


def url_number(col: Column) -> Column:
    """The number at the end of an id such as ``https://host/W123``."""
    return F.regexp_extract(col, r"(\d+)$", 1).cast("long")


def last_segment(col: Column) -> Column:
    """The last path segment as a number."""
    return F.element_at(F.split(col, "/"), -1).cast("long")


def short_key(col: Column) -> Column:
    return F.substring(col, 1, 8)


def split_list(col: Column, sep: str = ";") -> Column:
    """Items of a joined list; blank text gives none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), sep), lambda x: x != "")


def join_list(col: Column, sep: str = ";") -> Column:
    return F.array_join(col, sep)


def json_strings(col: Column, sep: str = " ") -> Column:
    """A JSON array of strings joined into one string."""
    return F.array_join(F.from_json(col, "array<string>"), sep)


def year_offset(year: Column, start: int) -> Column:
    return (year - F.lit(start)).cast("int")


def period(year: Column, filters) -> Column:
    """Index of the last filter year that is not after the year; 0 before all."""
    out = F.lit(0)
    for i, first in enumerate(filters):
        out = F.when(year >= first, F.lit(i)).otherwise(out) if i else out
    return out.cast("int")


def clean_name(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit("")))


def plain_letters(col: Column) -> Column:
    """Lower case, with Latin accents removed."""
    out = F.translate(F.lower(col), ACCENTED, PLAIN)
    for one, two in DOUBLED.items():
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def name_words(col: Column) -> Column:
    """Words of letters a-z: split at spaces, all other characters dropped; at most 32, and none from the word that holds the 256th letter on."""
    kept = F.regexp_replace(plain_letters(F.coalesce(col, F.lit(""))), "[^a-z ]", "")
    words = F.slice(F.filter(F.split(kept, " "), lambda w: w != ""), 1, MAX_WORDS)
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("words"))

    def step(acc, w):
        n = acc["n"] + F.length(w)
        return F.struct(n.alias("n"), F.when(n < MAX_LETTERS, F.concat(acc["words"], F.array(w))).otherwise(acc["words"]).alias("words"))

    return F.aggregate(words, zero, step, lambda acc: acc["words"])


def slug(col: Column) -> Column:
    return F.array_join(name_words(col), "-")


def journal_name(col: Column, least_length: int = 10, least_rate: float = 0.8) -> Column:
    """Of a name "A/B" whose parts nearly agree, the first part; else the name."""
    parts = F.split(col, "/")
    first, second = F.get(parts, 0), F.get(parts, 1)
    shorter = F.least(F.octet_length(first), F.octet_length(second))
    alike = F.lit(1.0) - F.levenshtein(first, second) / shorter >= F.lit(least_rate)
    return F.when((F.size(parts) == 2) & (shorter >= least_length) & alike, first).otherwise(col)


def doi_suffix(col: Column) -> Column:
    return F.substring(col, 17, 2_000_000)


def quartile_label(col: Column) -> Column:
    out = F.lit("Uncategorized")
    for q in (1, 2, 3, 4):
        out = F.when(col == q, F.lit(f"Q{q}")).otherwise(out)
    return out


def impact_features(papers: Column, citations: Column) -> tuple[Column, Column]:
    """Log citations, and citations a paper with at least three papers assumed."""
    return F.log(F.greatest(citations, F.lit(1)).cast("double")), citations / F.greatest(papers, F.lit(3))


def first_active_year(yearly_papers: Column, first_year: int) -> Column:
    """First year with papers of a yearly array that begins at ``first_year``; null if none."""
    at = F.array_position(F.transform(yearly_papers, lambda n: n > 0), True)
    return F.when(at > 0, (at + first_year - 1).cast("int"))
