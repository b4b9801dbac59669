"""Exact quantiles and ranks of groups of any size.

A quantile is found in two scans. The first counts rows per (group, value span),
combined map-side to a small histogram, which tells the spans that hold the wanted
positions. The second reads only the rows of those spans. Nothing shuffles or sorts
a whole group, and no group is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline import skew


@dataclass(frozen=True)
class Kind:
    """How a quantile picks from the sorted values: the positions it reads and the result from them.

    A position is zero-based over rows, or a running weight that must be reached.
    """

    positions: Callable[[Column, float], list[Column]]
    by_weight: bool = False

    def reached(self, upto: Column, position: Column) -> Column:
        return (upto >= position) if self.by_weight else (upto > position)


def _h(n: Column, p: float) -> Column:
    return (n - 1) * F.lit(p)


KINDS = {
    # interpolated between the two neighbours of (n-1)p
    "linear": Kind(lambda n, p: [F.floor(_h(n, p)), F.ceil(_h(n, p))]),
    # nearest rank, halves to even
    "nearest": Kind(lambda n, p: [F.bround(_h(n, p), 0)]),
    # rank rounded down
    "floor": Kind(lambda n, p: [F.floor(_h(n, p))]),
    # rank rounded up
    "ceil": Kind(lambda n, p: [F.ceil(n * F.lit(p)) - 1]),
    # first value whose running weight reaches p of the total
    "weighted": Kind(lambda n, p: [n * F.lit(p)], by_weight=True),
    # upper of the two middle values
    "upper_middle": Kind(lambda n, p: [F.floor(n / 2)]),
}


def quantiles(df: DataFrame, keys: Sequence[str], value: str, width: float, points: dict[str, float],
              kind: str = "linear", weight: str | None = None) -> DataFrame:
    """One row per group with a column per ``{name: p}``. ``width`` is the value span of a histogram cell."""
    k = KINDS[kind]
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), *([F.col(weight).alias("__wt")] if weight else []))
    d = d.withColumn("__span", skew.span("__v", width))
    w = F.sum("__wt") if weight else F.count(F.lit(1))
    by_key = Window.partitionBy(*keys)
    hist = d.groupBy(*keys, "__span").agg(w.alias("__w")).withColumns({
        "__n": F.sum("__w").over(by_key), "__upto": F.sum("__w").over(by_key.orderBy("__span").rowsBetween(Window.unboundedPreceding, 0))})
    hist = hist.withColumn("__before", F.coalesce(F.sum("__w").over(by_key.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.col("__n")
    wanted = F.lit(False)
    for p in points.values():
        for pos in k.positions(n, p):
            # floating weights may sum slightly short of the total: the last span always qualifies for what is left
            wanted = wanted | (k.reached(F.col("__upto"), pos) & ~k.reached(F.col("__before"), pos))
    need = skew.prefixed(hist.where(wanted).select(*keys, "__span", "__before", "__n"), [*keys, "__span"], "__s_")
    near = d.join(need, skew.null_safe([*keys, "__span"], "__s_"))
    cells = near.groupBy(*keys, "__span", "__v").agg(w.alias("__w"), F.max("__before").alias("__before"), F.max("__n").alias("__n"))
    run = F.sum("__w").over(Window.partitionBy(*keys, "__span").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("__at", F.col("__before") + run)
    read = {}
    for name, p in points.items():
        for i, pos in enumerate(k.positions(n, p)):
            read[f"__q{i}_{name}"] = F.min(F.when(k.reached(F.col("__at"), pos), F.col("__v")))
    g = cells.groupBy(*keys).agg(F.max("__n").alias("__n"), *[c.alias(name) for name, c in read.items()])
    out = []
    for name, p in points.items():
        lo = F.col(f"__q0_{name}")
        if kind == "linear":
            h = _h(n, p)
            lo = lo + (F.col(f"__q1_{name}") - lo) * (h - F.floor(h))
        out.append(lo.alias(name))
    return g.select(*keys, *out)


def median(df: DataFrame, keys: Sequence[str], value: str, width: float, out: str) -> DataFrame:
    return quantiles(df, keys, value, width, {out: 0.5})


def median_mad(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Median and median absolute deviation per group as ``med`` and ``mad``."""
    med = median(df, keys, value, width, "med")
    joined = df.join(med, list(keys)) if keys else df.withColumn("med", med.scalar())
    dev = joined.withColumn("__dev", F.abs(F.col(value) - F.col("med")))
    mad = median(dev, keys, "__dev", width, "mad")
    return med.join(mad, list(keys)) if keys else med.withColumn("mad", mad.scalar())


def ranks(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Per row: ``rank_min``, ``rank_avg``, ``rank_desc`` (1-based) and ``n`` of its value in the group.

    Ranks are made on the distinct values and joined back.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__w"))
    t = skew.running(cells, keys, [value], skew.span(value, width), {"__upto": ("sum", "__w")}, totals={"__total": ("sum", "__w")})
    r = t.select(*[F.col(k).alias(f"__g_{k}") for k in [*keys, value]], (F.col("__upto") - F.col("__w") + 1).alias("rank_min"),
                 (F.col("__upto") - (F.col("__w") - 1) / 2).alias("rank_avg"), (F.col("__total") - F.col("__upto") + 1).alias("rank_desc"), F.col("__total").alias("n"))
    return df.join(r, skew.null_safe([*keys, value], "__g_")).drop(*[f"__g_{k}" for k in [*keys, value]])
