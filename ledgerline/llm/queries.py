"""The operators of this folder as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from ledgerline.llm import adaptive_rules, collocations, decontaminate, exact_dedup, mixing, pseudonyms, ranked_search, secrets
from ledgerline.llm.near_dups import near_duplicates
from ledgerline.llm.quality import score_quality
from ledgerline.llm.records import encode_to_records
from ledgerline.llm.sharding import shard_by_bytes
from ledgerline.llm.token_counts import count_tokens
from ledgerline.llm.tokens import read_spec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


@register()
def op1_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return out.withColumns({"law": F.lit("bytes"), "shard": F.col("shard").cast("int"), "grown_shard": F.lit(None).cast("int")})


@register(exact_dedup.SQL)
def op2_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@register(secrets.SQL)
def op3_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = {f"n_{k}": secrets.count_kind("base", k) for k in secrets.BASE}
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


@register()
def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = encode_to_records(table(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("word_bpe_49k.json")), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "at", "offset", "length")


@register()
def op5_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


#: For the registered query; a deployment brings its own.
QUERY_KEY = "public-example-key"


@register()
def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return out.select("doc_id", "text", F.col("values").cast("long").alias("n_values"), F.array_join("kinds", ",").alias("kinds"))


@register(decontaminate.SQL)
def op7_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@register()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("byte_bpe_50k.json")), limit=512)


@register()
def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register(mixing.SQL)
def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "copies", "position")


@register(adaptive_rules.SQL)
def op11_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", F.when(F.col("n_words") > 0, F.col("level")).alias("level"))


@register(collocations.SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@register(ranked_search.SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
