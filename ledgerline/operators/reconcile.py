"""Set operations, explained differences and evidence tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage


def evidence_class(ladder: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """Label of the first condition that holds; null conditions do not."""
    out = None
    for name, cond in ladder:
        c = F.coalesce(cond, F.lit(False))
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(otherwise)


def evidence_rows(sources: dict[str, DataFrame]) -> DataFrame:
    """Distinct (code, kind, item) rows of several evidence tables with the number of items per kind.

    Kept long: a code with very many items stays spread over rows.
    """
    rows = None
    for kind, df in sources.items():
        r = df.select("code", F.lit(kind).alias("kind"), "item").distinct()
        rows = r if rows is None else rows.unionByName(r)
    n = rows.groupBy("code", "kind").agg(F.count(F.lit(1)).alias("items_of_kind"))
    return rows.join(n, ["code", "kind"])


def bag(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def _on(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return cond


def bag_compare(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Multiplicities of both sides per signature; both are combined before the join."""
    l, r = bag(left, cols).alias("l"), bag(right, cols).alias("r")
    j = l.join(r, _on(cols), "full_outer")
    return j.select(*[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in cols],
                    F.coalesce("l.n", F.lit(0)).alias("n_left"), F.coalesce("r.n", F.lit(0)).alias("n_right"))


def bag_intersection_mass(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    c = bag_compare(left, right, cols)
    return c.agg(F.sum("n_left").alias("left_rows"), F.sum("n_right").alias("right_rows"),
                 F.sum(F.least("n_left", "n_right")).alias("shared_rows"))


def bag_difference(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-sided rows in both directions with their multiplicity."""
    c = bag_compare(left, right, cols).where("n_left <> n_right")
    return c.select(*cols, F.when(F.col("n_left") > F.col("n_right"), "LEFT_ONLY").otherwise("RIGHT_ONLY").alias("side"),
                    F.abs(F.col("n_left") - F.col("n_right")).alias("n"))


def copy_union(parts: DataFrame, index: str, digest: str, priority: str, source: str) -> DataFrame:
    """One preferred copy per index and a flag when copies disagree."""
    return parts.groupBy(index).agg(
        F.count(F.lit(1)).alias("copies"), (F.count_distinct(digest) > 1).alias("conflict"),
        F.min_by(source, F.struct(priority, source)).alias("chosen"), F.min_by(digest, F.struct(priority, source)).alias("digest"))


#: Indices of one bitmap: the size that Spark's bitmap functions fix.
BITMAP = 32768


def _holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indices without a bit, up to the largest one; a bucket without a bitmap has none set."""
    for batch in batches:
        for bucket, bits, top in zip(*(batch.column(n).to_pylist() for n in ("bucket", "bits", "top")), strict=True):
            there = np.unpackbits(np.frombuffer(bits, "uint8"), bitorder="little") if bits else np.zeros(BITMAP, "uint8")
            missing = bucket * BITMAP + np.flatnonzero(there[:min(BITMAP, top + 1 - bucket * BITMAP)] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(missing.astype("int64"))], ["missing"])


def missing_indices(parts: DataFrame, index: str) -> DataFrame:
    """Holes in 0..max(index), from bitmaps that are combined map-side.

    A bitmap takes 4 KB for 32,768 indices, however often each occurs, so no set of
    indices is hashed, sorted or joined, and the work is spread over the buckets.
    """
    i = parts.select(F.col(index).cast("bigint").alias("i")).where("i >= 0")
    found = cut_lineage(i.groupBy(F.floor(F.col("i") / BITMAP).alias("bucket")).agg(F.bitmap_construct_agg(F.col("i") % BITMAP).alias("bits"), F.max("i").alias("top")))
    top = found.agg(F.max("top")).first()[0]
    buckets = parts.sparkSession.range(0 if top is None else top // BITMAP + 1).select(F.col("id").alias("bucket"))
    x = buckets.join(found.drop("top"), "bucket", "left").withColumn("top", F.lit(top).cast("bigint"))
    return x.mapInArrow(_holes, "missing bigint")


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Key agreement and largest absolute difference per value of two results."""
    l = left.select(*keys, *[F.col(v).alias(f"l_{v}") for v in values], F.lit(True).alias("in_l"))
    r = right.select(*keys, *[F.col(v).alias(f"r_{v}") for v in values], F.lit(True).alias("in_r"))
    j = l.join(r, list(keys), "full_outer")
    return j.agg(F.count_if(F.col("in_l") & F.col("in_r")).alias("matched"),
                 F.count_if(F.col("in_r").isNull()).alias("left_only"), F.count_if(F.col("in_l").isNull()).alias("right_only"),
                 *[F.max(F.abs(F.col(f"l_{v}") - F.col(f"r_{v}"))).alias(f"max_diff_{v}") for v in values])


def undirected(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("end_low"), F.greatest(a, b).alias("end_high")]


def override(base: DataFrame, changes: DataFrame, key: Sequence[str], action: str, add: str, remove: str) -> DataFrame:
    """Calendar rule with dated exceptions: listed removals drop out, listed additions come in."""
    drop = changes.where(F.col(action) == remove).select(*key)
    extra = changes.where(F.col(action) == add).select(*key)
    return base.select(*key).join(drop, list(key), "left_anti").unionByName(extra).distinct()


def replace_class(states: DataFrame, rebuilt: DataFrame, key: Sequence[str], replaceable: Column) -> DataFrame:
    """Swaps the replaceable rows for rebuilt ones; fails when a rebuilt key would hit a protected row."""
    keep = states.where(~replaceable)
    clash = rebuilt.select(*key).join(keep.select(*key), list(key), "left_semi")
    guard = clash.agg(F.when(F.count(F.lit(1)) > 0, F.raise_error(F.lit("rebuilt rows collide with protected states")).cast("boolean"))
                      .otherwise(F.lit(True))).scalar()
    return keep.unionByName(rebuilt).where(guard)


def unpivot_values(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Identifier-like columns of several tables as (tbl, col, val) text rows."""
    out = None
    for name, (df, cols) in tables.items():
        u = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "col", "val").withColumn("tbl", F.lit(name))
        out = u if out is None else out.unionByName(u)
    return out
