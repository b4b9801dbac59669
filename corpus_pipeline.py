"""Documents to training records, stage by stage: quality, near duplicates, benchmark leaks, mixture, token records."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, mixing, near_dups, quality, records
from ledgerline.llm.tokens import read_spec
from ledgerline.session import stage

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose calibrated chance of good quality is below this goes.
LEAST_QUALITY = 0.3
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a digest of id and text, by which they are found again; rows of one key are the same document."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), ":").otherwise(F.concat(F.lit("="), F.col("text"))))
    return docs.select(*DOCUMENT).withColumn("__key", F.unhex(F.sha2(own, 256)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs.select(*DOCUMENT), _table(spark, sf_dir, "labels"), LEAST_QUALITY)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, of repeated rows one; all others stay."""
    rows = _keyed(docs)
    classes = near_dups.near_duplicates(rows, keep=["__key"])
    kept = classes.groupBy("class").agg(F.min_by("__key", F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("__key"))
    return rows.join(kept.select("__key"), "__key", "left_semi").dropDuplicates(["__key"]).select(*DOCUMENT)


def cut_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut from the texts; a document of which no word is left goes."""
    cleaned = decontaminate.remove_leaks(docs.select(*DOCUMENT), _table(spark, sf_dir, "benchmark"))
    cleaned = cleaned.where(~F.col("cut") | F.regexp_like("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")))
    return cleaned.withColumn("n_chars", F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, range-sorted by training position."""
    rows = _keyed(docs)
    mixed = mixing.training_order(mixing.curriculum(rows, keep=["__key"])).select("__key", "position", "copy")
    # rows of one key are the same, each taken place gets one
    return rows.dropDuplicates(["__key"]).join(mixed, "__key").orderBy("position", "__key", "copy").select(*DOCUMENT)


def write_token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary token records in the shared folder, in the order of the rows of ``docs`` as written; returns their index as read back from the files.

    The mixture is range-sorted, so file by file and row by row is its training order. A
    frame that was not read from files has no such order and goes by id.
    """
    order = ["__file", "__row"] if docs.inputFiles() else []
    if order:
        docs = docs.select(*DOCUMENT, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    index = records.encode_to_records(docs, read_spec(public_tokenizers.path(TOKENIZER)), END_ID, order=order)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "at", "offset", "length")


STAGES = [("quality_classifier", keep_quality), ("near_duplicates", keep_one_of_near_duplicates), ("benchmark_decontamination", cut_leaks),
          ("mix_sources", mix_sources), ("token_records", write_token_records)]
#: Learnt scores and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
