"""Readable unique ids from names."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import slug
from ..scratch import written

#: Fixed value: what is appended, after a hyphen, to the last candidate when all are taken.
SUFFIXES = "23456789abcdefghijklmno"


def source_candidates(name: Column, alternates: Column, abbreviation: Column) -> Column:
    """Alternate titles and the abbreviation, shortest first, then the name; as slugs."""
    short = F.concat(F.coalesce(alternates, F.array().cast("array<string>")), F.when(abbreviation.isNotNull(), F.array(abbreviation)).otherwise(F.array().cast("array<string>")))
    return F.transform(F.concat(_by_length(short), F.array(name)), slug)


def institution_candidates(name: Column, acronyms: Column, alternatives: Column, country: Column) -> Column:
    """Acronyms, alternatives, the name, the name without "University of" or "University", and with its country, shortest first; as slugs."""
    none = F.array().cast("array<string>")
    before, after = "University of ", " University"
    stripped = F.concat(
        F.when(F.startswith(name, F.lit(before)), F.array(F.substring(name, len(before) + 1, 10_000))).otherwise(none),
        F.when(F.endswith(name, F.lit(after)), F.array(F.left(name, F.length(name) - len(after)))).otherwise(none),
    )
    placed = F.concat_ws(" ", F.trim(name), F.coalesce(country, F.lit("")))
    return F.transform(_by_length(F.concat(F.coalesce(acronyms, none), F.coalesce(alternatives, none), F.array(name), stripped, F.array(placed))), slug)


def _by_length(items: Column) -> Column:
    """Stable order by bytes."""
    keyed = F.transform(items, lambda x, i: F.struct(F.octet_length(x).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def unique_slugs(rows: DataFrame, slug_col: str = "slug") -> DataFrame:
    """(id, slug) from (id, works, slug), one candidate each: most works first, then the higher id; the k-th of a slug gets
    the (k - 1)-th suffix, and those beyond the suffixes get ''. A natural slug is not checked against a suffixed one.
    """
    place = F.row_number().over(Window.partitionBy(slug_col).orderBy(F.desc("works"), F.desc("id")))
    suffix = F.substring(F.lit(SUFFIXES), F.col("__k") - 1, F.lit(1))
    out = F.when(F.col("__k") == 1, F.col(slug_col)).when(F.col("__k") <= len(SUFFIXES) + 1, F.concat(F.col(slug_col), F.lit("-"), suffix)).otherwise("")
    return rows.withColumn("__k", place).select("id", out.alias("slug"))


def assign_slugs(rows: DataFrame) -> DataFrame:
    """(id, slug) from (id, works, candidates): in order of most works, then the higher id, each takes its first free candidate, else its
    last with the first free suffix, else ''. Without candidates: ''. Null works come last; ids are taken to be unique.

    An id claims one of its forms, the first in order holds it, all others go on to their next form; a holder gives way to an earlier one
    that comes later. As every form prefers the same order, the rounds end where assigning one id after the other would. Three things keep
    them few and small. A form that one id alone lists is never contested: an id that comes to it is settled and leaves. Of ids with the
    same list the k-th in order can get no form before the k-th, so it starts there. And what is carried from round to round, in a table
    written each time, are the ids at contested forms; when no more than ``FINISH_ROWS`` are left they are assigned in order in one task.
    A form's holder is a maximum and ids are joined by id, so a form that many want makes no large group.
    """
    none = F.array().cast("array<string>")
    suffixed = F.transform(F.sequence(F.lit(1), F.lit(len(SUFFIXES))), lambda i: F.concat(F.element_at("candidates", -1), F.lit("-"), F.substring(F.lit(SUFFIXES), i, F.lit(1))))
    forms = F.when(F.size("candidates") > 0, F.array_distinct(F.concat("candidates", suffixed))).otherwise(none)
    every = rows.select("id", F.coalesce("works", F.lit(-1)).alias("works"), F.coalesce("candidates", none).alias("candidates"))
    every = written(every.select("id", "works", forms.alias("forms")), "forms")
    state = written(_starts(every), "slugs")
    settled = [state.filter(_is_settled()).select("id", _form().alias("slug"))]
    state = state.filter(~_is_settled())
    while True:
        left = state.count()
        if left <= FINISH_ROWS:
            if left:
                settled.append(state.groupBy().applyInArrow(_in_order, settled[0].schema))
            break
        holders = state.groupBy(_form().alias("form")).agg(F.max(F.struct("works", "id")).alias("best")).select(F.col("best.id").alias("id"), F.lit(1).alias("held"))
        moved = state.join(holders, "id", "left").withColumn("lost", F.col("held").isNull())
        moved = written(moved.select("id", "works", "forms", "alone", (F.col("at") + F.col("lost").cast("int")).alias("at"), "lost"), "slugs")
        if moved.filter("lost").isEmpty():
            settled.append(moved.select("id", _form().alias("slug")))
            break
        settled.append(moved.filter(_is_settled()).select("id", _form().alias("slug")))
        state = moved.filter(~_is_settled()).drop("lost")
    found = reduce(DataFrame.unionByName, settled)
    return every.select("id").join(found, "id", "left").select("id", F.coalesce("slug", F.lit("")).alias("slug"))


#: When so few ids are left their forms are assigned in one task; another number changes the time, not the result.
FINISH_ROWS = 20_000


def _form() -> Column:
    return F.get("forms", F.col("at"))


def _is_settled() -> Column:
    """At a form of its own, or past all forms."""
    return (F.col("at") >= F.size("forms")) | (F.col("at") >= F.coalesce("alone", F.lit(1 << 30)))


def _starts(every: DataFrame) -> DataFrame:
    """(id, works, forms, alone, at): where an id starts in its forms, and the first of them that nobody else lists. Ids that can get no form are left out."""
    listed = every.select("id", F.posexplode("forms").alias("pos", "form"))
    own = listed.groupBy("form").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("pos").alias("pos")).filter("n = 1")
    alone = own.groupBy("id").agg(F.min("pos").alias("alone"))
    longest = every.agg(F.max(F.size("forms"))).first()[0] or 0
    alike = Window.partitionBy("forms").orderBy(F.desc("works"), F.desc("id"))
    # the limit is taken within each partition first, so that a list that many share makes no large group
    first = every.filter(F.size("forms") > 0).withColumn("at", F.row_number().over(alike)).filter(F.col("at") <= max(1, longest)).withColumn("at", F.col("at") - 1)
    return first.filter(F.col("at") < F.size("forms")).join(alone, "id", "left").select("id", "works", "forms", "alone", "at")


def _in_order(group: pa.Table) -> pa.Table:
    taken, out = set(), []
    for row in sorted(group.to_pylist(), key=lambda r: (r["works"], r["id"]), reverse=True):
        form = next((f for f in row["forms"][row["at"] :] if f not in taken), "")
        taken.add(form)
        out.append((row["id"], form))
    return pa.table({"id": pa.array([i for i, _ in out], group.schema.field("id").type), "slug": pa.array([f for _, f in out], pa.string())})


def distinct_names(rows: DataFrame) -> DataFrame:
    """(id, name) from (id, name, country, city): of equal names each gets " (country)"; where that is still shared, the plain name and " (city)".

    An empty country or city adds nothing.
    """
    def tagged(tag: str) -> Column:
        return F.when(F.coalesce(F.col(tag), F.lit("")) == "", F.col("name")).otherwise(F.concat(F.col("name"), F.lit(" ("), F.col(tag), F.lit(")")))

    shared = F.count("*").over(Window.partitionBy("name")) > 1
    first = rows.withColumn("__first", F.when(shared, tagged("country")).otherwise(F.col("name")))
    again = F.count("*").over(Window.partitionBy("__first")) > 1
    return first.select("id", F.when(again, tagged("city")).otherwise(F.col("__first")).alias("name"))
