"""Token counts from a digest cache.

The cache is a written table of (content digest, tokenizer version, count). Contents are
looked up by digest, only distinct contents that are missing are encoded, and their
counts are appended, so that a second run over grown data encodes what is new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import require, text_of
from ledgerline.llm.records import blocks_of
from ledgerline.llm.tokens import ByteCounter, loaded
from ledgerline.session import fresh_path, stage

_CACHE_DDL = "digest binary, version string, n_tokens long"


def version_of(spec: str) -> str:
    """Digest of everything that decides a count besides the content."""
    return hashlib.sha256(f"{tokenizers.__version__}\n{spec}".encode()).hexdigest()


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """One count per digest of this version; entries that two writers appended at once are the same."""
    try:
        stored = spark.read.schema(_CACHE_DDL).parquet(path)
    except AnalysisException:  # nothing was appended yet
        stored = spark.createDataFrame([], _CACHE_DDL)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, spec: str, limit: int, cache_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the tokenizers library without added special tokens; special
    strings inside texts are what the library takes them for. Null text is the empty
    content: 0 bytes, 0 tokens. Rows with equal ids are separate documents; rows with
    equal texts are encoded once. Without ``cache_path`` the call starts a new cache in
    the shared folder. An empty table gives no rows. Other columns are not read.
    """
    require(docs, doc_id, text)
    spark = docs.sparkSession
    cache_path = cache_path or fresh_path(spark, "token-cache")
    version = version_of(spec)
    shared = spark.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(ByteCounter, version, lambda: shared.value)
        for batch in batches:
            texts = batch.column(1)
            for a, z in blocks_of(texts, 2 << 20):
                counts = counter.count(texts.slice(a, z - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array([version] * (z - a), pa.string()), pa.array(counts, pa.int64())],
                                                 ["digest", "version", "n_tokens"])

    value = text_of(text)
    digest = F.unhex(F.sha2(value, 256))
    facts = stage(docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(value).cast("long").alias("n_bytes"), digest.alias("digest")), "facts")
    # of equal contents one row is read again: the one with the smallest id; a null id only without another
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("__first"))
    misses = first.join(read_cache(spark, cache_path, version), "digest", "left_anti").withColumnRenamed("digest", "__digest")
    texts = docs.select(F.col(doc_id).alias("doc_id"), value.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    met = texts.join(misses.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("digest") == F.col("__digest")), "left_semi").select("digest", "text")
    met.mapInArrow(encode, _CACHE_DDL).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    return facts.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
