"""Join operators Spark has no built-in form for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import skew


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", one_to_one: bool = False) -> DataFrame:
    """Join whose declared-unique side is checked inside the same job.

    The unique side is grouped by its key, which the join needs shuffled that way
    anyway; a repeated key raises.
    """
    def unique(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest])
        return g.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("join key is not unique")).cast("boolean")).otherwise(F.lit(True))).drop("__n")
    return (unique(left) if one_to_one else left).join(unique(right), list(keys), how)


def split_over_candidates(df: DataFrame, row: Sequence[str], candidates: DataFrame, key: str, out: str = "share") -> DataFrame:
    """Every row meets all candidates of its key with equal shares summing to one."""
    n = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(candidates.join(n, key), key).withColumn(out, F.lit(1.0) / F.col("__n")).drop("__n")


def best_tier(df: DataFrame, key: Sequence[str], tier: str) -> DataFrame:
    """All candidates that share their key's best tier."""
    best = df.groupBy(*key).agg(F.min(tier).alias(tier))
    return df.join(best, [*key, tier], "left_semi")


def unambiguous(df: DataFrame, name: str, key: str) -> DataFrame:
    """Names that lead to exactly one key."""
    return df.groupBy(name).agg(F.min(key).alias(key), F.max(key).alias("__hi")).where(F.col(key) == F.col("__hi")).drop("__hi")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, fields: Sequence[str], width: float,
         out: str, following: bool = False, strict: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Latest right row at or before each left row (earliest at or after with ``following``).

    Both sides are put on one time line and the last right row is carried forward
    through time chunks, so there is no pair expansion and no whole key in one task.
    Right rows of equal time are reduced to the one with the smallest ``tie`` first.
    """
    pay = [right_time, *[f for f in fields if f != right_time]]
    best = right.groupBy(*keys, F.col(right_time).alias("__t")).agg(
        (F.min_by(F.struct(*pay), F.struct(*tie)) if tie else F.max(F.struct(*pay))).alias("__r"))
    # at equal times the right row comes first going backward unless strict, last going forward
    right_first = following == strict
    lcols = left.columns
    l = left.withColumns({"__t": F.col(left_time), "__side": F.lit(1 if right_first else 0)}).withColumn("__id", F.monotonically_increasing_id())
    r = best.withColumns({"__side": F.lit(0 if right_first else 1), "__id": F.lit(0).cast("bigint")})
    both = l.unionByName(r, allowMissingColumns=True)
    x = skew.last_known(both, keys, ["__t", "__side", "__id"], skew.span("__t", width), "__r", out, following=following)
    return x.where(F.col("__side") == (1 if right_first else 0)).select(*lcols, out)


def arrival_index(rides: DataFrame, keys: Sequence[str], dep: str, arr: str, ride: str, width: float) -> DataFrame:
    """Per departure time the best arrival among it and all later departures (arr, dep, ride)."""
    r = rides.where(F.col(arr) > F.col(dep)).withColumn("__cand", F.struct(F.col(arr).alias("arr"), F.col(dep).alias("dep"), F.col(ride).alias("ride")))
    r = skew.running(r, keys, [dep, ride], skew.span(dep, width), {"best": ("min", "__cand")}, suffix=True)
    return r.groupBy(*keys, F.col(dep).alias("index_dep")).agg(F.min("best").alias("best"))


def first_arrival(left: DataFrame, index: DataFrame, keys: Sequence[str], ready: str, width: float, out: str) -> DataFrame:
    """Forward as-of lookup in an arrival index."""
    x = asof(left, index, keys, ready, "index_dep", ["best"], width, "__hit", following=True)
    return x.withColumn(out, F.col("__hit.best")).drop("__hit")


def earliest_arrival(left: DataFrame, rides: DataFrame, keys: Sequence[str], ready: str, dep: str, arr: str, ride: str, width: float,
                     out: str) -> DataFrame:
    """Among rides leaving at or after ``ready``, the one that arrives first (then leaves first, then smallest id)."""
    return first_arrival(left, arrival_index(rides, keys, dep, arr, ride, width), keys, ready, width, out)


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lo: str, hi: str, at: str, width: int) -> DataFrame:
    """Right rows with ``lo <= at <= hi``: equi-join on key and time bucket, then the exact test.

    Choose ``width`` near the usual hi-lo, so that each left row meets few buckets. The
    bucket is part of the join key, so a hot key is spread over its time range.
    """
    l = left.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    r = right.withColumn("__b", F.floor(F.col(at) / width))
    return l.join(r, [*keys, "__b"]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("__b")


def band_pairs(df: DataFrame, keys: Sequence[str], at: str, row_id: str, gap: int, fields: Sequence[str]) -> DataFrame:
    """Row pairs of the same keys with 0 <= later - earlier < gap, the earlier one first.

    The output is as large as the number of such pairs; only rows in the same or the
    next bucket of width ``gap`` ever meet.
    """
    a = df.select(*keys, F.col(at).alias("a_at"), F.col(row_id).alias("a_id"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = df.select(*keys, F.col(at).alias("b_at"), F.col(row_id).alias("b_id"), *[F.col(f).alias(f"b_{f}") for f in fields])
    own = F.floor(F.col("a_at") / gap)
    a = a.withColumn("__b", F.explode(F.array(own, own + 1)))
    b = b.withColumn("__b", F.floor(F.col("b_at") / gap))
    order = (F.col("a_at") < F.col("b_at")) | ((F.col("a_at") == F.col("b_at")) & (F.col("a_id") < F.col("b_id")))
    return a.join(b, [*keys, "__b"]).where(order & (F.col("b_at") - F.col("a_at") < gap)).drop("__b")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, fields: Sequence[str], tolerance: float,
            width: float, out: str, tie: Sequence[str], upper: str | None = None) -> DataFrame:
    """Closest right row within the tolerance and not after ``upper``; smallest ``tie`` first on equal distance.

    One time line gives the neighbours on both sides, so nothing is paired up.
    """
    pay = [right_time, *[f for f in [*fields, *tie] if f != right_time]]
    pay = list(dict.fromkeys(pay))
    best = right.groupBy(*keys, F.col(right_time).alias("__t")).agg(F.min_by(F.struct(*pay), F.struct(*tie)).alias("__r"))
    look = F.least(F.col(left_time), F.col(upper)) if upper else F.col(left_time)
    lcols = left.columns
    l = left.withColumns({"__t": look, "__side": F.lit(1)}).withColumn("__id", F.monotonically_increasing_id())
    r = best.withColumns({"__side": F.lit(0), "__id": F.lit(0).cast("bigint")})
    both = l.unionByName(r, allowMissingColumns=True)
    # at equal times the right row lies behind, so an exact hit is found looking back
    x = skew.chunked(both, keys, ["__t", "__side", "__id"], skew.span("__t", width), known={"__before": ("__r", False, False), "__after": ("__r", True, False)})
    x = x.where("__side = 1")
    b, a = F.col("__before"), F.col("__after")
    db, da = F.abs(F.col(left_time) - b[right_time]), F.abs(a[right_time] - F.col(left_time))
    b_ok = b.isNotNull() & (db <= tolerance)
    a_ok = a.isNotNull() & (da <= tolerance) & ((a[right_time] <= F.col(upper)) if upper else F.lit(True))
    first = (db < da) | ((db == da) & (F.struct(*[b[c] for c in tie]) <= F.struct(*[a[c] for c in tie])))
    return x.select(*lcols, F.when(b_ok & (~a_ok | first), b).when(a_ok, a).alias(out))


def expand_segments(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per segment between two positions, with the direction of travel."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    return (df.where(F.col(start) != F.col(end))
            .withColumn("segment", F.explode(F.sequence(lo, hi - 1))).withColumn("outbound", F.col(end) > F.col(start)))


def zip_chains(df: DataFrame, left: Column, right: Column, row: Sequence[str]) -> DataFrame:
    """Two lists zipped by position; a length mismatch is flagged, not dropped."""
    z = df.select(*row, (F.size(left) == F.size(right)).alias("arity_ok"), F.posexplode_outer(
        F.when(F.size(left) == F.size(right), F.arrays_zip(left.alias("l"), right.alias("r")))).alias("pos", "pair"))
    return z.select(*row, "arity_ok", "pos", F.col("pair.l").alias("left_item"), F.col("pair.r").alias("right_item"))
