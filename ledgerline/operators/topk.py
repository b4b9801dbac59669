"""Ordering, top-k, suppression and one-to-one matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.session import cut_lineage


def best_per_group(df: DataFrame, keys: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """The row with the smallest rank per key, as a map-side combined aggregate. ``rank`` must be a total order."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("__b"))
    return g.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def beam(df: DataFrame, keys: Sequence[str], log_score: str, tie: Sequence[str], k: int) -> DataFrame:
    """Best ``k`` rows per key with ``retained``: the kept part of the key's probability, measured before the cut.

    The rank filter is applied before the shuffle as well, so each task sends at most k rows per key.
    """
    lse = df.groupBy(*keys).agg(F.max(log_score).alias("__top"))
    all_mass = df.join(lse, list(keys)).groupBy(*keys).agg(F.max("__top").alias("__top"), F.sum(F.exp(F.col(log_score) - F.col("__top"))).alias("__all"))
    w = Window.partitionBy(*keys).orderBy(F.desc(log_score), *tie)
    kept = df.withColumn("beam_rank", F.row_number().over(w)).where(F.col("beam_rank") <= k).join(all_mass, list(keys))
    share = F.exp(F.col(log_score) - F.col("__top")) / F.col("__all")
    totals = kept.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(share)).alias("retained"))
    return kept.drop("__top", "__all").join(totals, list(keys))


def suppress(df: DataFrame, keys: Sequence[str], position: str, rank: Sequence[Column], separation: int, width: int) -> DataFrame:
    """Greedy suppression: by rank, keep a row when no kept row is nearer than ``separation``.

    Equal to the sequential greedy pass: in each round a row that outranks every
    undecided row within reach is kept and its neighbours fall. A round is one shuffle
    over position chunks with a halo; rounds go on until nothing is undecided.
    """
    reach = separation - 1
    if reach <= 0:
        return df
    cols = df.columns
    span = Window.partitionBy(*keys, "__chunk").orderBy(position).rangeBetween(-reach, reach)
    open_rows = df.withColumn("__rank", F.struct(*rank))
    kept = None
    while True:
        h = skew.halo(open_rows, position, 2 * reach, max(width, 2 * reach))
        h = h.withColumn("__win", F.min("__rank").over(span) == F.col("__rank"))
        h = h.withColumn("__hit", F.max("__win").over(span))
        done = cut_lineage(skew.owned(h))
        won = done.where("__win").select(*cols)
        kept = won if kept is None else kept.unionByName(won)
        open_rows = done.where("not __hit").select(*cols, "__rank")
        if open_rows.isEmpty():
            return kept


def greedy_match(pairs: DataFrame, group: Sequence[str], left: str, right: str, rank: Sequence[Column]) -> DataFrame:
    """One-to-one matching: pairs in rank order, taken when both ends are free.

    Each round takes the pairs that are best for both of their ends, which the
    sequential pass takes too, and drops every pair touching them.
    """
    cols = pairs.columns
    open_pairs = pairs.withColumn("__rank", F.struct(*rank))
    kept = None
    while True:
        l = open_pairs.groupBy(*group, left).agg(F.min("__rank").alias("__lb"))
        r = open_pairs.groupBy(*group, right).agg(F.min("__rank").alias("__rb"))
        x = open_pairs.join(l, [*group, left]).join(r, [*group, right])
        won = cut_lineage(x.where((F.col("__rank") == F.col("__lb")) & (F.col("__rank") == F.col("__rb"))).select(*cols))
        kept = won if kept is None else kept.unionByName(won)
        open_pairs = cut_lineage(open_pairs.join(won.select(*group, left), [*group, left], "left_anti")
                                 .join(won.select(*group, right), [*group, right], "left_anti").select(*cols, "__rank"))
        if open_pairs.isEmpty():
            return kept


def reject_ties(df: DataFrame, keys: Sequence[str], score: str, direction: str) -> DataFrame:
    """Best rows per key, dropped when the best score is reached in more than one direction."""
    best = df.groupBy(*keys).agg(F.max(score).alias(score))
    top = df.join(best, [*keys, score], "left_semi")
    clear = top.groupBy(*keys).agg(F.min(direction).alias("__lo"), F.max(direction).alias("__hi")).where("__lo = __hi").select(*keys)
    return top.join(clear, list(keys), "left_semi")
