"""Session construction, shared-storage paths and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    executors share one machine, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = os.environ.get("LEDGERLINE_LOCAL_SHARED")
        if not root:
            root = tempfile.mkdtemp(prefix="spark-ledgerline-")
            os.environ["LEDGERLINE_LOCAL_SHARED"] = root
    return "/".join([root.rstrip("/"), *parts])


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path under the shared folder."""
    return shared_dir(spark, f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise on shared storage, so that a lost executor costs no recomputation.

    A written table rather than an RDD checkpoint: it is computed once (a checkpoint
    runs its last stage again to save it), is read column by column, and its file sizes
    tell the optimizer how large it is.
    """
    return stage(df, "cut")


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once to shared storage and read back: for results used several times."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
