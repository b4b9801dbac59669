"""Grouped, weighted and conserved aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.operators import quantiles as Q


def decimal_sum(c: str | Column) -> Column:
    """Exact decimal sum of numeric or text amounts."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(28,6)")).cast("decimal(38,6)")


def cohorts(df: DataFrame, keys: Sequence[str], mass: str = "passenger_mass") -> DataFrame:
    """Identical rows combined into one row with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(mass))


def zero_filled(df: DataFrame, bin_col: str, bins: int, counts: dict[str, Column]) -> DataFrame:
    """Histogram over bins 0..bins-1 with empty bins as zero."""
    hist = df.groupBy(bin_col).agg(*[c.alias(n) for n, c in counts.items()])
    axis = df.sparkSession.range(bins).select(F.col("id").alias(bin_col))
    return axis.join(hist, bin_col, "left").fillna(0, list(counts))


def densify(df: DataFrame, keys: Sequence[str], axis: str, lo: int, hi: int, values: Sequence[str]) -> DataFrame:
    """Every key gets each axis position lo..hi; absent cells become explicit zeros."""
    grid = df.select(*keys).distinct().withColumn(axis, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return grid.join(df, [*keys, axis], "left").fillna(0, list(values))


def collision_audit(df: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """What a coarse key would merge: groups, rows, rows lost by naive dedup, groups over several labels."""
    g = df.groupBy(*key, label).agg(F.count(F.lit(1)).alias("n"))
    per_key = g.groupBy(*key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    dup = F.col("n") > 1
    return per_key.agg(
        F.count_if(dup).alias("collision_groups"), F.sum("n").alias("rows"),
        F.sum(F.when(dup, F.col("n")).otherwise(0)).alias("colliding_rows"),
        F.sum(F.col("n") - 1).alias("rows_removed_by_dedup"), F.count_if(F.col("labels") > 1).alias("groups_over_labels"))


def corr(x: str, y: str) -> Column:
    """Correlation, null when a side is flat (the built-in one divides by zero there in ANSI mode)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pearson(x: str, y: str, min_n: int = 3) -> Column:
    """Population correlation; 0 with too few rows or a flat side."""
    ok = (F.count(F.col(x) + F.col(y)) >= min_n) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(ok, corr(x, y)).otherwise(F.lit(0.0))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, width_x: float, width_y: float, out: str) -> DataFrame:
    """Correlation of average ranks."""
    rx = Q.ranks(df, keys, x, width_x).withColumnRenamed("rank_avg", "__rx").drop("rank_min", "rank_desc", "n")
    ry = Q.ranks(rx, keys, y, width_y)
    return ry.groupBy(*keys).agg(corr("__rx", "rank_avg").alias(out))


def weighted_mean(x: str, w: str) -> Column:
    return F.sum(F.col(x) * F.col(w)) / F.sum(w)


def weighted_variance(x: str, w: str) -> Column:
    mean2 = F.sum(F.col(x) * F.col(x) * F.col(w)) / F.sum(w)
    return mean2 - weighted_mean(x, w) * weighted_mean(x, w)


def entropy(df: DataFrame, keys: Sequence[str], mass: str, out: str) -> DataFrame:
    """Shannon entropy of the mass shares: ln(W) - sum(w ln w)/W in one map-side combined pass."""
    w = F.col(mass)
    return df.where(w > 0).groupBy(*keys).agg((F.ln(F.sum(w)) - F.sum(w * F.ln(w)) / F.sum(w)).alias(out))


def mode(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Smallest most frequent value; a null key is a group of its own."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(out))


def mode_with_fallback(train: DataFrame, target: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Group mode of the training rows, the global mode where the group is unseen."""
    per = mode(train, [key], value, out).withColumnRenamed(key, "__g")
    overall = mode(train, [], value, out)
    return (target.join(per, F.col(key).eqNullSafe(F.col("__g")), "left").drop("__g")
            .withColumn(out, F.coalesce(F.col(out), overall.scalar())))


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    per = df.groupBy(truth).agg(F.avg(hit).alias("recall"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg("recall").alias("balanced_accuracy"),
                   (F.sum(F.col("recall") * F.col("n")) / F.sum("n")).alias("raw_accuracy"))


def nmae(predicted: str, truth: str) -> Column:
    return F.sum(F.abs(F.col(predicted) - F.col(truth))) / F.sum(F.abs(F.col(truth)))


def wasserstein(df: DataFrame, position: str, a: str, b: str, width: float) -> DataFrame:
    """Area between the two weighted distribution functions over ``position``."""
    cells = df.groupBy(position).agg(F.sum(a).alias("a"), F.sum(b).alias("b"))
    chunk = skew.span(position, width)
    run = skew.running(cells, [], [position], chunk, {"ca": ("sum", "a"), "cb": ("sum", "b")})
    run = skew.neighbour(run, [], [position], chunk, [position], "nxt", following=True)
    total = cells.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    gap = F.abs(F.col("ca") / F.col("__t.a") - F.col("cb") / F.col("__t.b")) * (F.col(f"nxt.{position}") - F.col(position))
    return run.withColumn("__t", total).agg(F.sum(gap).alias("wasserstein"))


def total_variation(left: DataFrame, right: DataFrame, keys: Sequence[str], item: str, mass: str, out: str) -> DataFrame:
    """Half the absolute share differences over the union of items, per group."""
    def shares(df, name):
        m = df.groupBy(*keys, item).agg(F.sum(mass).alias("__m"))
        tot = m.groupBy(*keys).agg(F.sum("__m").alias("__t")) if keys else None
        j = m.join(tot, list(keys)) if keys else m.withColumn("__t", m.agg(F.sum("__m")).scalar())
        return j.select(*keys, item, (F.col("__m") / F.col("__t")).alias(name))
    both = shares(left, "__p").join(shares(right, "__q"), [*keys, item], "full_outer").fillna(0.0, ["__p", "__q"])
    return both.groupBy(*keys).agg((F.sum(F.abs(F.col("__p") - F.col("__q"))) / 2).alias(out))


def allocate(df: DataFrame, keys: Sequence[str], mass: str, weight: str | None, out: str) -> DataFrame:
    """Mass of a group split over its rows by weight (equally without one); each row carries the group mass."""
    w = F.col(weight) if weight else F.lit(1.0)
    d = skew.attach(df, keys, [F.sum(w).alias("__w"), F.count(F.lit(1)).alias("__n")])
    share = F.when(F.col("__w") > 0, w / F.col("__w")).otherwise(F.lit(1.0) / F.col("__n"))
    return d.withColumn(out, F.col(mass) * share).drop("__w", "__n")


def conservation_error(df: DataFrame, keys: Sequence[str], mass: str, part: str) -> DataFrame:
    per = df.groupBy(*keys).agg(F.max(mass).alias("m"), F.sum(part).alias("s"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.max(F.abs(F.col("m") - F.col("s"))).alias("max_error"))


def residual_class(parts: DataFrame, totals: DataFrame, keys: Sequence[str], label: str, mass: str, name: str) -> DataFrame:
    """Adds the part of each total that the listed parts leave over, clipped at zero, as its own class."""
    inside = parts.groupBy(*keys).agg(F.sum(mass).alias("__in"))
    rest = (totals.join(inside, list(keys), "left")
            .select(*keys, F.lit(name).alias(label),
                    F.greatest(F.col(mass) - F.coalesce("__in", F.lit(0.0)), F.lit(0.0)).alias(mass)))
    return parts.select(*keys, label, mass).unionByName(rest)


def share_of_group(df: DataFrame, group: Sequence[str], item: Sequence[str], mass: str, out: str) -> DataFrame:
    cells = df.groupBy(*group, *item).agg(F.sum(mass).alias(mass))
    tot = cells.groupBy(*group).agg(F.sum(mass).alias("__t"))
    return cells.join(tot, list(group)).withColumn(out, F.when(F.col("__t") > 0, F.col(mass) / F.col("__t"))).drop("__t")


def scale_fit(df: DataFrame, base: str, observed: str, is_observed: str, out: str) -> DataFrame:
    """Least-squares scale of ``base`` to the observed cells; the others are predicted from it."""
    o = F.col(is_observed)
    fit = df.agg((F.sum(F.when(o, F.col(base) * F.col(observed)))
                  / F.sum(F.when(o, F.col(base) * F.col(base)))).alias("s")).scalar()
    return df.withColumn("__s", fit).withColumn(
        out, F.when(o, F.col(observed)).otherwise(F.col(base) * F.col("__s"))).drop("__s")


def bounded_peers(items: DataFrame, fields: Sequence[str], limit: int) -> DataFrame:
    """One row holding the items as an array; fails beyond ``limit`` instead of growing."""
    packed = items.limit(limit + 1).agg(F.collect_list(F.struct(*fields)).alias("peers"))
    return packed.select(F.when(F.size("peers") <= limit, F.col("peers")).otherwise(
        F.raise_error(F.lit(f"more than {limit} items"))).alias("peers"))


def gravity(zones: DataFrame, zone: str, out_mass: str, in_mass: str, x: str, y: str, beta: float, limit: int) -> DataFrame:
    """P_i * A_j * exp(-beta d) over a bounded zone set, zero diagonal, normalised to one.

    The zone set is a top-``limit`` selection, so the grid has at most limit^2 cells:
    every zone row unfolds the one-row array of its peers.
    """
    peers = bounded_peers(zones, [zone, in_mass, x, y], limit)
    g = zones.withColumn("__p", F.explode(peers.scalar()))
    d = F.sqrt(F.pow(F.col(x) - F.col(f"__p.{x}"), 2) + F.pow(F.col(y) - F.col(f"__p.{y}"), 2))
    raw = F.when(F.col(zone) == F.col(f"__p.{zone}"), F.lit(0.0)).otherwise(
        F.col(out_mass) * F.col(f"__p.{in_mass}") * F.exp(-beta * d))
    cells = g.select(F.col(zone).alias("origin"), F.col(f"__p.{zone}").alias("destination"), d.alias("distance"), raw.alias("raw"))
    return cells.withColumn("prior", F.col("raw") / cells.agg(F.sum("raw")).scalar()).drop("raw")


def level_counts(df: DataFrame, dims: Sequence[str], levels: Sequence[Sequence[str]], mass: str) -> DataFrame:
    """Counters at several levels from one pass: combined at the finest grain, then grouping sets over that."""
    fine = df.groupBy(*dims).agg(F.sum(mass).alias("mass"), F.count(F.lit(1)).alias("n"))
    return fine.groupingSets([[F.col(c) for c in lv] for lv in levels], *dims).agg(
        F.grouping_id().alias("level_id"), F.sum("mass").alias("mass"), F.sum("n").alias("n"))
