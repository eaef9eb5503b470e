"""The numbered queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, decontaminate, embedding, exact_dedup, fill_in_middle, importance, licenses, packing, secrets, sharding, simhash, target_sampling, warc
from ._common import table


def op5_pigeonhole_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, good): labelled documents; good ones have quality and no toxicity."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents sampled for quality; the others are rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = importance.Resampler(docs, good_labels(spark, sf_dir)).kept()
    return kept.select(F.col("id").alias("doc_id"), "log_ratio", "gumbel_key", F.lit(True).alias("kept"))


def op2_brown_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = brown.score(table(spark, sf_dir, "documents"), held_out)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest",
    )


def tokenizer_path() -> str:
    """The public vocabulary file; workers read it where the package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    packed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), threshold=0.8)
    return found.select(
        F.col("id").alias("doc_id"), F.array_join("licenses", ",").alias("licenses"), F.size("passages").cast("bigint").alias("n_passages"),
        "license", F.round("dice", 6).alias("dice"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(secrets.all_spans(F.col("base"), F.col("added"))).alias("spans"),
    )


def op9_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.archive(table(spark, sf_dir, "pages")).filter("last")
    revisit = F.col("record_type") == "revisit"
    return chunks.select(
        "page_id", F.when(revisit, F.col("payload_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"), "record_type", "refers_to",
    )


def op10_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int"), F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = target_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op7_license_scan": op7_license_scan,
    "op5_pigeonhole_near_dedup": op5_pigeonhole_near_dedup,
    "op2_brown_class_scores": op2_brown_class_scores,
    "op3_suffix_automaton_decontamination": op3_suffix_automaton_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_chunked_warc": op9_chunked_warc,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op10_best_fit_sharding": op10_best_fit_sharding,
    "op11_target_resampling": op11_target_resampling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op9_chunked_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        o as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as owner from p)
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id <> owner then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id <> owner then owner end as refers_to
        from o
    """,
    # crc32 bit by bit over the distinct words' bytes
    "op11_target_resampling": r"""
        with low as (select 0 as side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
            union all select 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
        found as (select side, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from low),
        uses as (select side, doc_id, unnest(ws) as w from found),
        hexed as (select w, hex(w) as hx from (select distinct w from uses)),
        bits as (select w, list_transform(range(0, 4 * length(hx)), lambda k: (cast('0x' || substr(hx, 2 * (k // 8) + 1, 2) as bigint) >> (k % 8)) & 1) as bs from hexed),
        coded as (select w, xor(list_reduce(list_concat([4294967295::bigint], bs), lambda a, b: case when xor(a, b) & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 10000 as bucket from bits),
        per_bucket as (select bucket, cast(sum(1 - side) as double) as s, cast(sum(side) as double) as t from uses join coded using (w) group by bucket),
        gain as (select bucket, cast(floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000)))) as bigint) as gain from per_bucket),
        weights as (select doc_id, cast(floor(sum(gain) / cast(count(*) as double)) as bigint) as weight from uses join coded using (w) join gain using (bucket) where side = 0 group by doc_id),
        scored as (select f.doc_id, cast(len(ws) as bigint) as n_features, coalesce(weight, 0) as weight,
            coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || f.doc_id), 1, 8) as bigint) + 0.5e0) / 4294967296e0))) as bigint) as score
            from found f left join weights w on w.doc_id = f.doc_id where f.side = 0),
        placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) filter (where n_features >= 20) over () as n from scored)
        select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from placed
    """,
    "op12_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm, length(coalesce(text, '')) as chars from documents)
        select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = first_value(doc_id) over best as kept, sha256(norm) as text_sha256
        from n window best as (partition by norm order by chars desc, doc_id)
    """,
    "op13_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as h from documents),
        u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as lines, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
                     cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
        c as (select *, len(lines) as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as b,
                     case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
        p as (select *, case when a = 0 then '' else array_to_string(lines[1:a], '') end as pre, case when a = b then '' else array_to_string(lines[a + 1:b], '') end as mid,
                     case when b = n then '' else array_to_string(lines[b + 1:n], '') end as suf from c)
        select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
               sha256(t) as restored_sha256 from p
    """,
}
