"""Deterministic sampling, splits and resampling by hash."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.functions import hashing


def keyed(*cols: str, salt: str = "") -> Column:
    return F.concat(F.lit(salt), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def hash_shard(df: DataFrame, key: Column, shards: int, shard: int | None = None) -> DataFrame:
    x = df.withColumn("shard", hashing.bucket(key, shards))
    return x if shard is None else x.where(F.col("shard") == shard)


def capped_sample(df: DataFrame, key: Column, cap: int) -> DataFrame:
    """The ``cap`` rows of smallest hash: each task keeps its own smallest, then those are merged."""
    return df.withColumn("__h", F.sha1(key)).orderBy("__h").limit(cap).drop("__h")


def folds(df: DataFrame, key: Column, n: int, held_out: int = 0, mass: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with fold and side, and the mass of each side; a key is wholly on one side."""
    x = df.withColumn("fold", hashing.bucket(key, n, hex_digits=15))
    x = x.withColumn("side", F.when(F.col("fold") == held_out, "HELDOUT").otherwise("TRAIN"))
    return x, x.groupBy("side").agg(F.count(F.lit(1)).alias("rows"), (F.sum(mass) if mass else F.count(F.lit(1))).alias("mass"))


def stratified_holdout(df: DataFrame, stratum: Sequence[str], key: Column, rate: float, min_train: int) -> DataFrame:
    """Marks the first min(n - min_train, max(1, round(rate * n))) rows by hash in each stratum.

    Hash order is chunked by its leading digits, which spreads any stratum evenly.
    """
    x = df.withColumns({"__h": F.sha2(key, 256), "__one": F.lit(1).cast("bigint")})
    chunk = F.conv(F.substring("__h", 1, 3), 16, 10).cast("bigint")
    x = skew.running(x, stratum, ["__h"], chunk, {"__rank": ("sum", "__one")}, totals={"__n": ("sum", "__one")})
    want = F.when(F.col("__n") > min_train, F.least(F.col("__n") - min_train, F.greatest(F.lit(1), F.bround(F.col("__n") * rate, 0).cast("bigint")))).otherwise(0)
    return x.withColumn("held_out", F.col("__rank") <= want).drop("__h", "__one", "__rank", "__n")


def target_masks(df: DataFrame, key: Column, targets: Sequence[str], share: float) -> DataFrame:
    """Independent mask per target: the rows whose salted hash falls below the share."""
    return df.withColumns({f"mask_{t}": hashing.unit_interval(F.concat(F.lit(f"{t}|"), key)) < share for t in targets})


def poisson_weight(key: Column, seed: str | Column, upto: int = 20) -> Column:
    """Poisson(1) count from a hash-uniform number by inverse distribution.

    The chance of more than 20 is below the resolution of the hash number.
    """
    u = hashing.unit_interval(F.concat(F.lit(seed) if isinstance(seed, str) else seed, F.lit("|"), key))
    total, term, w = 0.0, math.exp(-1.0), F.lit(0)
    for k in range(upto):
        total += term
        w = w + F.when(u >= total, 1).otherwise(0)
        term /= k + 1
    return w


def bootstrap_counts(df: DataFrame, keys: Sequence[str], key: Column, replicates: int) -> DataFrame:
    """Resampled counts per replicate and cell; replicates are a column, summed map-side."""
    x = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    x = x.withColumn("__w", poisson_weight(key, F.col("replicate").cast("string")))
    return x.groupBy("replicate", *keys).agg(F.sum("__w").alias("x")).where("x > 0")


def stability(found: DataFrame, item: Sequence[str], replicate: str, replicates: int) -> DataFrame:
    """Share of replicates that recover an item, with its label."""
    g = found.groupBy(*item).agg(F.count_distinct(replicate).alias("hits"))
    r = F.col("hits") / F.lit(float(replicates))
    return g.withColumn("recovered", r).withColumn("label", F.when(r >= 5 / 6, "STABLE").when(r >= 2 / 3, "LIKELY").otherwise("WEAK"))
