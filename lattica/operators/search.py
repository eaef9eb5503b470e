"""Prefix and infix search over names, on an inverted index of words and word endings.

The index holds (token, rank, kind): every word of a name ("word"), and every ending of a word that leaves out at least its first letter and
keeps at least two ("inner"). Ranks are the names' places, 0 the best.

A stored index answers a whole table of queries in one plan. It has three tables: ``lists``, for every beginning of a word or an
ending the best 16 names, which answer queries of one word; ``tokens``, all words and endings, for the first of several words; and ``names``,
each name's words, against which the words after the first are tested. The first two are written in folders by the first two letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import name_words
from ..scratch import written

LIMIT = 16
QUERY_WORDS = 3


def build_index(names: DataFrame) -> DataFrame:
    """(token, rank, kind) from (rank, name)."""
    words = names.select("rank", F.explode(name_words(F.col("name"))).alias("token")).distinct()
    inner = words.filter(F.length("token") >= 3).select("rank", F.explode(F.transform(F.sequence(F.lit(2), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.length("token")))).alias("token"))
    return words.select("token", "rank", F.lit("word").alias("kind")).unionByName(inner.distinct().select("token", "rank", F.lit("inner").alias("kind")))


def query_words(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(name_words(F.lit(text)).alias("w")).first()["w"]


def _either_starts(col, word: str):
    return F.startswith(col, F.lit(word)) | F.startswith(F.lit(word), col)


def _matches(index: DataFrame, word: str, infix: bool, narrowed: bool) -> DataFrame:
    """(rank, partial): 0 for exact words, 1 for beginnings and inner matches."""
    token, word_rows, inner_rows = F.col("token"), index.filter("kind = 'word'"), index.filter("kind = 'inner'")
    if len(word) < 2:
        # of one letter the lowest ranks alone are known, and count as exact
        hits = word_rows.filter(F.startswith(token, F.lit(word))).select("rank", F.lit(0).alias("partial")).distinct().orderBy("rank").limit(LIMIT)
        inner = inner_rows.filter(F.startswith(token, F.lit(word))).select("rank", F.lit(1).alias("partial")).distinct().orderBy("rank").limit(LIMIT)
    else:
        begins = _either_starts(token, word) & (F.length("token") >= 2) if narrowed else F.startswith(token, F.lit(word))
        hits = word_rows.filter(begins).select("rank", F.when(token == word, 0).otherwise(1).alias("partial"))
        inner = inner_rows.filter((F.substring(token, 1, 2) == word[:2]) & _either_starts(token, word)).select("rank", F.lit(1).alias("partial"))
    if infix:
        hits = hits.unionByName(inner)
    return hits.groupBy("rank").agg(F.min("partial").alias("partial"))


def search(index: DataFrame, text: str) -> DataFrame:
    """(rank, partial) of at most 16 names: exact word matches by rank, then the others by rank.

    One word looks inside words only if fewer than 16 names match at a beginning. Of several words the first three count: each narrows
    what the ones before it matched.
    """
    words = query_words(index.sparkSession, text)[:QUERY_WORDS]
    if not words:
        return index.filter("kind = 'word'").select("rank").distinct().orderBy("rank").limit(LIMIT).withColumn("partial", F.lit(0))
    if len(words) == 1:
        found = _matches(index, words[0], infix=False, narrowed=False)
        enough = found.limit(LIMIT).count() >= LIMIT
        if not enough:
            found = _matches(index, words[0], infix=True, narrowed=False)
    else:
        found = _matches(index, words[0], infix=True, narrowed=False)
        for word in words[1:]:
            found = _matches(index, word, infix=True, narrowed=True).join(found.select("rank"), "rank", "left_semi")
    return found.orderBy("partial", "rank").limit(LIMIT)


def _letters(key: str) -> Column:
    """The folder of a key: its first two letters; a mark for the empty one, as an empty name would be null when read."""
    return F.when(F.col(key) == "", "_").otherwise(F.substring(key, 1, 2))


def _in_folders(rows: DataFrame, key: str, folder: str) -> None:
    """Written by the first two letters of the key, in order of keys; many keys of the same letters make several files."""
    rows = rows.withColumn("letters", _letters(key))
    rows.repartitionByRange("letters", key).sortWithinPartitions("letters", key).write.partitionBy("letters").option("compression", "zstd").parquet(folder)


def _beginnings(rows: DataFrame, kind: str, first: int, last: Column) -> DataFrame:
    at = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    return rows.select(F.explode(F.transform(at, lambda n: F.substring(F.col("token"), F.lit(1), n))).alias("key"), F.lit(kind).alias("kind"), "rank")


def store_index(names: DataFrame, folder: str) -> None:
    """Write the index of (rank, name). Names without a word are in none of its tables; a null name is an empty one.

    Lists have the kinds "exact" (a word equals the key), "begin" (a word starts with it and is longer; of keys of at most one letter also one
    that equals it), "inner" (an ending starts with it) and "ending" (an ending equals it). A list is cut to its best 16 ranks within each
    partition before the shuffle, so that short keys make no large groups.
    """
    spark = names.sparkSession
    worded = written(names.select(F.col("rank").cast("long").alias("rank"), name_words(F.col("name")).alias("words")).filter(F.size("words") > 0), "names")
    worded.repartitionByRange("rank").sortWithinPartitions("rank").write.option("compression", "zstd").parquet(f"{folder}/names")
    _in_folders(build_index(names).dropDuplicates(["token", "rank", "kind"]), "token", f"{folder}/tokens")
    tokens = spark.read.parquet(f"{folder}/tokens")
    words, inner = tokens.filter("kind = 'word'"), tokens.filter("kind = 'inner'")
    length = F.length("token")
    keyed = (
        words.select(F.col("token").alias("key"), F.lit("exact").alias("kind"), "rank")
        .unionByName(_beginnings(words, "begin", 0, F.greatest(length - 1, F.least(length, F.lit(1)))))
        .unionByName(_beginnings(inner, "inner", 1, length))
        .unionByName(inner.select(F.col("token").alias("key"), F.lit("ending").alias("kind"), "rank"))
    )
    best = keyed.withColumn("place", F.dense_rank().over(Window.partitionBy("key", "kind").orderBy("rank"))).filter(F.col("place") <= LIMIT)
    lists = best.groupBy("key", "kind").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    _in_folders(lists, "key", f"{folder}/lists")


def _read(spark: SparkSession, folder: str, table: str, letters: list[str]) -> DataFrame:
    """Only the folders of the given letters."""
    return spark.read.schema({"lists": _LISTS, "tokens": _TOKENS}[table]).parquet(f"{folder}/{table}").filter(F.col("letters").isin(letters))


_LISTS = "key string, kind string, ranks array<long>, letters string"
_TOKENS = "token string, rank long, kind string, letters string"


def _partial(word: Column, words: Column) -> Column:
    """How a name of ``words`` matches a later word of a query of at least two letters: 0 as a word, 1 in part, null not at all."""

    def begins(x: Column) -> Column:
        return F.startswith(x, word) | (F.startswith(word, x) & (F.length(x) >= 2))

    def within(x: Column) -> Column:
        longest = F.least(F.length(word), F.length(x) - 1)
        endings = F.when(longest >= 2, F.sequence(F.lit(2), longest)).otherwise(F.array().cast("array<int>"))
        return F.contains(F.substring(x, 2, 1 << 30), word) | F.exists(endings, lambda n: F.endswith(x, F.substring(word, F.lit(1), n)))

    return F.when(F.array_contains(words, word), 0).when(F.exists(words, lambda x: begins(x) | ((F.length(x) >= 3) & within(x))), 1)


def search_many(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """(query, place, rank, partial): for every row of (query, text) what ``search`` finds, best first from place 1.

    A query of one word meets the few lists that bear its letters, by equality; of several words the first meets the words of its two
    letters, and the names it finds are tested for the others. Only folders of letters that occur in the queries are read. A null text is an
    empty one and finds the first 16 names with words; rows with the same query and text are one. ``query`` may be of any type.
    """
    asked = queries.select("query", F.slice(name_words(F.col("text")), 1, QUERY_WORDS).alias("words")).distinct()
    asked = written(asked.withColumn("first", F.coalesce(F.get("words", F.lit(0)), F.lit(""))), "queries")
    letters = [r[0] for r in asked.select(_letters("first")).distinct().collect()]  # at most 26 * 27 + 1
    lists = _read(spark, folder, "lists", letters)

    one = asked.filter(F.size("words") <= 1)
    key = lambda kind, partial, more, value="first": F.struct(F.col(value).alias("key") if isinstance(value, str) else value.alias("key"), F.lit(kind).alias("kind"), F.lit(partial).alias("partial"), F.lit(more).alias("more"))
    long, n = F.length("first") >= 2, F.length("first")
    shorter = F.when(n >= 3, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    endings = F.transform(shorter, lambda k: key("ending", 1, 1, F.substring(F.col("first"), F.lit(1), k)))
    keys = F.when(long, F.concat(F.array(key("exact", 0, 0), key("begin", 1, 0), key("inner", 1, 1)), endings)).when(n == 1, F.array(key("begin", 0, 0), key("inner", 1, 1)))
    wanted = one.select("query", F.inline(F.coalesce(keys, F.array(key("begin", 0, 0)))))
    hits = wanted.withColumn("letters", _letters("key")).join(lists, ["letters", "key", "kind"]).select("query", "partial", "more", F.explode("ranks").alias("rank"))
    found = hits.groupBy("query", "rank").agg(F.min("partial").alias("partial"), F.min("more").alias("more"))
    begun = F.sum(1 - F.col("more")).over(Window.partitionBy("query"))  # a query meets a bounded number of lists of 16
    short = found.withColumn("begun", begun).filter((F.col("more") == 0) | (F.col("begun") < LIMIT))

    several = asked.filter(F.size("words") > 1)
    starts, token = F.startswith("token", F.col("first")), F.col("token")
    met = (starts & (F.col("kind") == "word")) | ((F.col("kind") == "inner") & (starts | F.startswith("first", token)))
    tokens = _read(spark, folder, "tokens", [x for x in letters if len(x) == 2])
    at_two = several.filter(long).withColumn("letters", F.substring("first", 1, 2)).join(tokens, "letters").filter(met)
    alphabet = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    of_letter = spark.read.schema(_LISTS).parquet(f"{folder}/lists").filter(F.col("letters").isin(alphabet) & F.col("kind").isin("begin", "inner"))
    of_letter = of_letter.groupBy("letters").agg(F.first(F.when(F.col("kind") == "begin", F.col("ranks")), True).alias("begins"), F.first(F.when(F.col("kind") == "inner", F.col("ranks")), True).alias("inners"))
    of_letter = F.broadcast(of_letter)  # 26 rows of at most 32 ranks
    none = F.array().cast("array<long>")
    at_one = several.filter(n == 1).join(of_letter, F.col("first") == F.col("letters")).withColumn("rank", F.explode(F.concat(F.coalesce("begins", none), F.coalesce("inners", none))))
    matched = at_two.select("query", "words", "rank").unionByName(at_one.select("query", "words", "rank")).distinct()
    matched = matched.join(spark.read.schema("rank long, words array<string>").parquet(f"{folder}/names").withColumnRenamed("words", "own"), "rank")
    for i in range(1, QUERY_WORDS):
        word = F.get("words", F.lit(i))
        letter = of_letter.select(F.col("letters").alias(f"letter{i}"), F.col("begins").alias(f"begins{i}"), F.col("inners").alias(f"inners{i}"))
        matched = matched.join(F.broadcast(letter), (word == F.col(f"letter{i}")), "left")
        single = F.when(F.array_contains(f"begins{i}", F.col("rank")), 0).when(F.array_contains(f"inners{i}", F.col("rank")), 1)
        matched = matched.withColumn(f"partial{i}", F.when(F.length(word) >= 2, _partial(word, F.col("own"))).otherwise(single)).filter(word.isNull() | F.col(f"partial{i}").isNotNull())
    last = F.when(F.size("words") > 2, F.col("partial2")).otherwise(F.col("partial1"))
    rest = matched.select("query", "rank", last.alias("partial"))

    place = F.row_number().over(Window.partitionBy("query").orderBy("partial", "rank"))
    return short.select("query", "rank", "partial").unionByName(rest).withColumn("place", place).filter(F.col("place") <= LIMIT).select("query", "place", "rank", "partial")
