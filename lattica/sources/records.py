"""Raw JSON-lines records to relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .. import schema
from ..functions.columns import clean_name, last_segment, url_number
from ..scratch import written


def read_records(spark: SparkSession, path: str, entity: str, strict: bool = True) -> DataFrame:
    """JSON-lines files (gzip too) under a folder, at any depth; a malformed line ends the read unless not ``strict``."""
    reader = spark.read.option("recursiveFileLookup", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.schema(schema.ENTITIES[entity]).json(path)


def read_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).option("mode", "FAILFAST").csv(path, header=True)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "gzip").csv(path, header=True, mode="overwrite")


def write_table(rows: DataFrame, path: str, keys: tuple[str, ...] = (), rows_per_file: int | None = None) -> None:
    """Parquet, in folders by ``keys``, with at most so many rows a file."""
    writer = rows.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def child_rows(rows: DataFrame, items: str, parent: str = "id") -> DataFrame:
    """(parent_id, position, item) of an array column."""
    return rows.select(F.col(parent).alias("parent_id"), F.posexplode(items).alias("position", "item"))


def split_nested(rows: DataFrame, name: str, key: str = "id") -> dict[str, DataFrame]:
    """The tables of nested records, by a walk over their schema: "<name>" for the records and "<name>_<field>" for every struct and array below, at
    any depth.

    A record's key is its column ``key`` as a string, kept as ``key``. A struct gives a row for each parent that has one; an array gives a row for
    each item, with its ``position`` from 0, and items that are no structs are in column ``value``. Such a row has its parent's key as
    ``parent_key`` and a key made of it, the field and the position, so keys are unique where those of the records are. Null structs, arrays and items
    give no rows; an empty array gives none. A table without plain fields has its keys only. The records are stored once, and each
    table reads its own columns of them.
    """
    stored = written(rows.withColumn("__key", F.col(key).cast("string")), name)
    out: dict[str, DataFrame] = {}

    def walk(table: str, frame: DataFrame, keys: list[str], item: str | None, fields: list[StructField]) -> None:
        inside = (lambda f: F.col(f"`{item}`.`{f}`")) if item else (lambda f: F.col(f"`{f}`"))
        nested = [f for f in fields if isinstance(f.dataType, (StructType, ArrayType))]
        plain = [inside(f.name).alias(_beside(f.name, keys)) for f in fields if f not in nested]
        out[table] = frame.select(*[F.col(f"__{k}").alias(k) for k in keys], *plain)
        for f in nested:
            below, kind = f"{table}_{f.name}", f.dataType
            parent = F.col("__key").alias("__parent_key")
            if isinstance(kind, StructType):
                child = frame.select(parent, F.concat_ws(".", "__key", F.lit(f.name)).alias("__key"), inside(f.name).alias("__item")).filter("__item is not null")
                walk(below, child, ["key", "parent_key"], "__item", kind.fields)
                continue
            child = frame.select(parent, F.posexplode(inside(f.name)).alias("__position", "__item")).filter("__item is not null")
            child = child.withColumn("__key", F.concat_ws(".", "__parent_key", F.lit(f.name), F.col("__position").cast("string")))
            where = ["key", "parent_key", "position"]
            if isinstance(kind.elementType, StructType):
                walk(below, child, where, "__item", kind.elementType.fields)
            else:
                walk(below, child.withColumnRenamed("__item", "value"), where, None, [StructField("value", kind.elementType)])

    walk(name, stored, ["key"], None, [f for f in rows.schema.fields])
    return out


def _beside(field: str, keys: list[str]) -> str:
    """The name of a record's field beside the keys of its table."""
    return f"{field}_" if field in keys else field


def json_values(text: Column, path: str, kind: str = "string") -> Column:
    """The array of values at a path of raw JSON text, in order, such as "$.authorships[*].author.id"; a star stands for every item of an array.

    A path that leads nowhere, a null, an item of another shape and a value that cannot be read as ``kind`` give nothing; malformed or null text gives
    an empty array.
    """

    def walk(value: Column, steps: list[str]) -> Column:
        head, *rest = steps
        if not rest:
            return F.array(F.try_variant_get(value, "$" + head, kind))
        items = F.try_variant_get(value, "$" + head, "array<variant>")
        return F.flatten(F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: walk(x, rest)))

    found = walk(F.try_parse_json(text), path.removeprefix("$").split("[*]"))
    return F.filter(F.coalesce(found, F.array().cast(f"array<{kind}>")), lambda x: x.isNotNull())


def split_works(works: DataFrame) -> dict[str, DataFrame]:
    """Main rows and child tables of works: references, topics, sources, authorships and their institutions."""
    works = works.withColumn("id", url_number(F.col("id")))
    main = works.select("id", "doi", F.coalesce("display_name", F.lit("")).alias("name"), "publication_year", "type", "is_retracted")
    topics = child_rows(works, "topics").select(F.col("parent_id").alias("work"), url_number(F.col("item.id")).alias("topic"), F.coalesce("item.score", F.lit(0.0)).alias("score"))
    sources = child_rows(works, "locations").select(F.col("parent_id").alias("work"), url_number(F.col("item.source.id")).alias("source"), "position")
    ships = child_rows(works, "authorships").withColumn("authorship", F.xxhash64("parent_id", "position"))
    return {
        "works": main,
        "work_references": child_rows(works, "referenced_works").select(F.col("parent_id").alias("work"), url_number(F.col("item")).alias("ref")),
        "work_topics": topics,
        "work_sources": sources.filter("source is not null"),
        "authorships": ships.select(F.col("authorship").alias("id"), F.col("parent_id").alias("work"), url_number(F.col("item.author.id")).alias("author")),
        "authorship_institutions": ships.select("authorship", F.explode("item.institutions").alias("i")).select("authorship", url_number(F.col("i.id")).alias("institution")),
    }


def entity_rows(rows: DataFrame, entity: str) -> DataFrame:
    """Main rows of the other entities, with numeric ids, cleaned names and joined lists."""
    key = last_segment(F.col("id")) if entity in ("fields", "subfields") else url_number(F.col("id"))
    rows = rows.withColumn("id", key).withColumn("name", clean_name(F.col("display_name"))).drop("display_name")
    if entity == "topics":
        return rows.select("id", "name", last_segment(F.col("subfield.id")).alias("subfield"), last_segment(F.col("field.id")).alias("field"))
    if entity == "subfields":
        return rows.select("id", "name", last_segment(F.col("field.id")).alias("field"))
    if entity == "institutions":
        return rows.select("id", "name", "country_code", F.col("geo.city").alias("city"), F.col("geo.country").alias("country"), "display_name_acronyms", "display_name_alternatives", F.array_join("display_name_acronyms", " ").alias("name_extension"))
    if entity == "sources":
        return rows.select("id", "name", "issn_l", "issn", "alternate_titles", "abbreviated_title", F.array_join("alternate_titles", " ").alias("name_extension"))
    return rows


def topic_export(works: DataFrame, topics: list[str], least_citations: int = 2, least_score: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cited works with a topic of the list over the score: (works, references, topics)."""
    good = F.exists("topics", lambda t: t["id"].isin(*topics) & (t["score"] > least_score))
    kept = works.filter((F.col("cited_by_count") >= least_citations) & good)
    return (
        kept.select("id", "display_name", "publication_year"),
        kept.select("id", F.explode("referenced_works").alias("ref")),
        kept.select("id", F.explode("topics").alias("t")).select("id", F.col("t.id").alias("topic"), F.col("t.score").alias("score")),
    )
