"""Write-once outputs with read-back verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.contracts import ContractError, with_reason
from ledgerline.sources.readers import path_exists

MARKER = "_QUALIFIED"


def write_by_date(df: DataFrame, date: str, path: str, files_per_date: int = 1) -> None:
    """One folder per date, zstd. The date also stays a data column.

    ``files_per_date`` spreads a heavy date over several writers by a row hash.
    """
    d = df.withColumn("part_date", F.col(date).cast("string"))
    if files_per_date > 1:
        d = d.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_date))).repartition("part_date", "__salt").drop("__salt")
    else:
        d = d.repartition("part_date")
    d.write.mode("errorifexists").option("compression", "zstd").partitionBy("part_date").parquet(path)


def write_csv(df: DataFrame, order: Sequence[str], path: str) -> None:
    """Sorted CSV parts with a fixed header, which an empty result keeps too."""
    df.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def column_totals(df: DataFrame, sums: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in sums])


def read_back(source: DataFrame, written: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Rows and column sums per key on both sides, with an agreement flag."""
    side = lambda df, p: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{p}_rows"), *[F.sum(c).alias(f"{p}_{c}") for c in sums])
    j = side(source, "src").join(side(written, "out"), list(keys), "full_outer")
    same = F.col("src_rows").eqNullSafe(F.col("out_rows"))
    for c in sums:
        same = same & F.col(f"src_{c}").eqNullSafe(F.col(f"out_{c}"))
    return j.withColumn("agree", same)


def rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(path(old), path(new)):
        raise ContractError(f"could not rename {old} to {new}")


def publish(df: DataFrame, path: str, sums: Sequence[str]) -> None:
    """Write beside the target, verify by re-reading, rename, then leave the qualification marker.

    An existing target is never overwritten.
    """
    spark = df.sparkSession
    if path_exists(spark, path):
        raise ContractError(f"{path} exists")
    building = path.rstrip("/") + ".building"
    df.write.mode("errorifexists").parquet(building)
    want, got = column_totals(df, sums).first(), column_totals(spark.read.parquet(building), sums).first()
    if want != got:
        raise ContractError(f"read-back differs: {want} against {got}")
    rename(spark, building, path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKER}")
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop_path, False).close()


def route_rejects(df: DataFrame, reasons: Sequence[tuple[str, Column]], path: str, accepted: str = "ACCEPTED") -> tuple[DataFrame, dict[str, int]]:
    """Writes good and rejected rows in one pass, a folder for each reason, and counts the reasons on the way.

    A row goes by its first reason. Returns the rows read back, with ``reason``, and the
    counts that the write observed; rows that were written and rows that were counted must
    be the same, else the outcome is in doubt and an error says so.
    """
    spark, names = df.sparkSession, [accepted, *[n for n, _ in reasons]]
    x = with_reason(df, reasons).withColumn("reason", F.coalesce("reason", F.lit(accepted)))
    seen = Observation()
    x = x.observe(seen, *[F.count_if(F.col("reason") == n).alias(f"n{i}") for i, n in enumerate(names)])
    x.write.mode("errorifexists").partitionBy("reason").parquet(path)
    counts = {n: seen.get[f"n{i}"] for i, n in enumerate(names)}
    back = spark.read.schema(x.schema).parquet(path)
    found = {r.reason: r["count"] for r in back.groupBy("reason").count().collect()}  # as many rows as reasons
    if {n: c for n, c in counts.items() if c} != found:
        raise ContractError(f"counted {counts}, read back {found}")
    return back, counts


def write_text_parts(df: DataFrame, part: str, order: Sequence[str], path: str) -> None:
    """One CSV file with a header for each part, its rows in order. Parts are bounded by whoever numbers them."""
    df.repartition(part).sortWithinPartitions(part, *order).write.mode("errorifexists").partitionBy(part).option("header", True).csv(path)


def text_manifest(df: DataFrame, part: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """What the file of each part has to be: ``part, rows, bytes, sha256``, from the rows themselves. Columns must print alike as text."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("__line")))), lambda x: x["__line"])
    whole = F.concat(F.lit(",".join(columns) + "\n"), F.array_join(lines, "\n"), F.lit("\n"))
    x = df.groupBy(part).agg(F.count(F.lit(1)).alias("rows"), whole.alias("__text"))
    return x.select(part, "rows", F.octet_length("__text").cast("bigint").alias("bytes"), F.sha2("__text", 256).alias("sha256"))


def verify_parts(spark: SparkSession, path: str, manifest: DataFrame, part: str) -> DataFrame:
    """Each part of the manifest or on disk with its ``status``: OK, CHANGED, MISSING or EXTRA; files are read as bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    held = files.groupBy(F.regexp_extract("path", f"{part}=([^/]+)", 1).cast(manifest.schema[part].dataType).alias(part)).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("found_bytes"), F.min(F.sha2("content", 256)).alias("found_sha256"))
    x = manifest.join(held, part, "full_outer")
    same = (F.col("files") == 1) & (F.col("bytes") == F.col("found_bytes")) & (F.col("sha256") == F.col("found_sha256"))
    status = F.when(F.col("files").isNull(), "MISSING").when(F.col("bytes").isNull(), "EXTRA").when(same, "OK").otherwise("CHANGED")
    return x.select(part, "rows", "found_bytes", "found_sha256", status.alias("status"))
