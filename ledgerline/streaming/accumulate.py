"""Incremental accumulation of files into a count store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def accumulate_counts(stream: DataFrame, keys: Sequence[str], store: str, progress: str, out: str = "x"):
    """Adds each batch's counts to the store, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, so no file
    is ever counted twice. Reading the store sums the batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def read_store(spark: SparkSession, store: str, keys: Sequence[str], out: str = "x") -> DataFrame:
    return spark.read.parquet(store).groupBy(*keys).agg(F.sum(out).alias(out))


def run_to_end(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


Transform = Callable[[DataFrame], DataFrame]
