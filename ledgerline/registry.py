"""Query registry: a Spark plan beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import cut_lineage


class Tables:
    """The driver tables of one scale folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return register


_STAGED: dict[tuple, object] = {}


def _state(t: Tables) -> tuple:
    """Names, sizes and times of the entries of a table folder: another state makes shared results anew."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(t.sf_dir)
    entries = path.getFileSystem(t.spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((e.getPath().getName(), e.getLen(), e.getModificationTime()) for e in entries))


def staged(fn: Callable[[Tables], object]):
    """Materialises a result that several queries read, once per application and state of the table folder."""
    def once(t: Tables):
        key = (t.spark.sparkContext.applicationId, t.sf_dir, _state(t), f"{fn.__module__}.{fn.__name__}")
        if key not in _STAGED:
            out = fn(t)
            _STAGED[key] = tuple(cut_lineage(d) for d in out) if isinstance(out, tuple) else cut_lineage(out)
        return _STAGED[key]
    return once


def forget_staged() -> None:
    """Drops the shared results, so that a timing includes making them."""
    _STAGED.clear()
