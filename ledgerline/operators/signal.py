"""Time-series operators on (series, bin) count tables.

Bins are integers. Windows are split into bin chunks with a halo, so a series may
be arbitrarily long and one series may hold most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.operators import aggregates as A
from ledgerline.operators import joins as J
from ledgerline.operators import quantiles as Q
from ledgerline.operators import topk as K
from ledgerline.session import cut_lineage

CHUNK_BINS = 4096


def count_grid(df: DataFrame, keys: Sequence[str], bin_col: str, out: str = "x") -> DataFrame:
    return df.groupBy(*keys, bin_col).agg(F.count(F.lit(1)).alias(out))


def dense_grid(df: DataFrame, keys: Sequence[str], bin_col: str, bins: int, out: str = "x") -> DataFrame:
    return A.densify(count_grid(df, keys, bin_col, out), keys, bin_col, 0, bins - 1, [out])


def frame(width: int) -> tuple[int, int]:
    """Offsets of a centred window; an even width reaches one further back."""
    after = (width - 1) // 2
    return after - width + 1, after


def moving_averages(grid: DataFrame, keys: Sequence[str], bin_col: str, value: str, widths: dict[str, int]) -> DataFrame:
    """Centred moving averages with zeros outside the series; all widths share one shuffle."""
    reach = max(widths.values())
    h = skew.halo(grid, bin_col, reach, max(CHUNK_BINS, reach))
    for out, width in widths.items():
        lo, hi = frame(width)
        w = Window.partitionBy(*keys, "__chunk").orderBy(bin_col).rangeBetween(lo, hi)
        h = h.withColumn(out, F.sum(value).over(w) / F.lit(float(width)))
    return skew.owned(h)


def highpass(grid: DataFrame, keys: Sequence[str], bin_col: str, value: str, short: int, long: int, out: str) -> DataFrame:
    m = moving_averages(grid, keys, bin_col, value, {"__s": short, "__l": long})
    return m.withColumn(out, F.col("__s") - F.col("__l")).drop("__s", "__l")


def pulse_scores(grid: DataFrame, keys: Sequence[str], bin_col: str, value: str, short: int, background: int) -> DataFrame:
    """Residual over its background: (short - long) / sqrt(max(long, 0.25))."""
    m = moving_averages(grid, keys, bin_col, value, {"short_avg": short, "background": background})
    m = m.withColumn("residual", F.col("short_avg") - F.col("background"))
    return m.withColumn("score", F.col("residual") / F.sqrt(F.greatest(F.col("background"), F.lit(0.25))))


def pulses(scored: DataFrame, keys: Sequence[str], bin_col: str, quantile: float, floor: float, separation: int,
           guard: int = 0, bins: int | None = None) -> DataFrame:
    """Separated local maxima of the score above the series' own threshold.

    ``guard`` drops that many bins at both ends of a series of ``bins`` bins.
    """
    th = Q.quantiles(scored, keys, "score", 0.25, {"__q": quantile})
    th = th.select(*keys, F.greatest(F.col("__q"), F.lit(floor)).alias("threshold"))
    h = skew.halo(scored, bin_col, 1, CHUNK_BINS)
    w = Window.partitionBy(*keys, "__chunk").orderBy(bin_col)
    h = skew.owned(h.withColumns({"__left": F.lag("score").over(w), "__right": F.lead("score").over(w)}))
    peak = ((F.col("score") >= F.coalesce("__left", "score")) & (F.col("score") >= F.coalesce("__right", "score")) & (F.col("residual") > 0))
    if guard:
        peak = peak & (F.col(bin_col) >= guard) & (F.col(bin_col) < bins - guard)
    cand = h.where(peak).drop("__left", "__right").join(th, list(keys)).where("score >= threshold")
    return K.suppress(cand, keys, bin_col, [-F.col("score"), F.col(bin_col)], separation, CHUNK_BINS)


def pulse_extent(found: DataFrame, scored: DataFrame, keys: Sequence[str], bin_col: str, value: str, half: int) -> DataFrame:
    """Span of positive residual around each pulse within ``half`` bins, with mass, background and excess."""
    h = skew.halo(scored, bin_col, half, max(CHUNK_BINS, half))
    w = Window.partitionBy(*keys, "__chunk").orderBy(bin_col)
    stop = F.when(F.col("residual") <= 0, F.col(bin_col))
    h = skew.owned(h.withColumns({
        "__lo": F.max(stop).over(w.rangeBetween(-half, -1)), "__hi": F.min(stop).over(w.rangeBetween(1, half)),
        "__first": F.min(bin_col).over(w.rangeBetween(-half, 0)), "__last": F.max(bin_col).over(w.rangeBetween(0, half))}))
    edge = h.select(*keys, bin_col, F.coalesce(F.col("__lo") + 1, "__first").alias("lo"), F.coalesce(F.col("__hi") - 1, "__last").alias("hi"))
    span = found.select(*keys, bin_col).join(edge, [*keys, bin_col]).withColumnRenamed(bin_col, "centre")
    cells = span.withColumn(bin_col, F.explode(F.sequence("lo", "hi"))).join(scored.select(*keys, bin_col, value, "background"), [*keys, bin_col])
    g = cells.groupBy(*keys, "centre", "lo", "hi").agg(F.sum(value).alias("mass"), F.sum("background").alias("background_mass"))
    return g.withColumn("excess", F.greatest(F.lit(0.0), F.col("mass") - F.col("background_mass")))


def lag_scores(signal: DataFrame, edges: DataFrame, series: str, bin_col: str, value: str, lags: Column, min_n: int = 60) -> DataFrame:
    """Correlation of x[t] at the edge's ``u`` with y[t+lag] at its ``v`` for every lag; flat or short overlaps are left out.

    Products are summed map-side per (edge, lag), so only one row per task, edge and lag is shuffled.
    """
    u = edges.join(signal.select(F.col(series).alias("u"), F.col(bin_col).alias("t"), F.col(value).alias("xu")), "u")
    v = signal.select(F.col(series).alias("v"), F.col(bin_col).alias("tv"), F.col(value).alias("xv"))
    j = u.withColumn("lag", F.explode(lags)).withColumn("tv", F.col("t") + F.col("lag")).join(v, ["v", "tv"])
    g = j.groupBy(*edges.columns, "lag").agg(F.count(F.lit(1)).alias("n"), A.corr("xu", "xv").alias("corr"))
    return g.where((F.col("n") >= min_n) & F.col("corr").isNotNull())


def best_lag(scores: DataFrame, edge: Sequence[str], expected: Column) -> DataFrame:
    """Lag of the best correlation; ties go to the lag nearest the expected one, then the smaller."""
    rank = F.struct(-F.round("corr", 9), F.abs(F.col("lag") - expected), F.col("lag"))
    return scores.groupBy(*edge).agg(F.min_by("lag", rank).alias("lag"), F.min_by("corr", rank).alias("corr"))


def lags_with_fallback(edges: DataFrame, best: DataFrame, edge: Sequence[str], min_score: float = 0.02) -> DataFrame:
    """Edges without a credible lag take the median of the credible ones; the source is kept."""
    good = best.where(F.col("corr") >= min_score)
    med = Q.median(good, [], "lag", 64.0, "m")
    j = edges.join(good, list(edge), "left")
    source = F.when(F.col("lag").isNotNull(), "CROSS_CORRELATION").otherwise("NETWORK_MEDIAN")
    return j.withColumns({"source": source, "lag": F.coalesce(F.col("lag").cast("double"), med.scalar())})


def cumulative_offsets(edge_lags: DataFrame, path: Sequence[str], seq: str, lag: str, out: str) -> DataFrame:
    """Offset of each path position from the first; a path is a short list, one chunk is enough."""
    return skew.running(edge_lags, path, [seq], None, {out: ("sum", lag)})


_CLUSTER_SCHEMA = "cluster_no int, pos double, weight double, member string"


def _cluster_island(pdf: pd.DataFrame, radius: float) -> np.ndarray:
    """Cluster number along one island: join while within the radius of the running weighted centre."""
    pos, weight = pdf["pos"].to_numpy(), pdf["weight"].to_numpy()
    label = np.zeros(len(pos), dtype=np.int32)
    centre, mass, current = pos[0], weight[0], 0
    for i in range(1, len(pos)):
        if abs(pos[i] - centre) <= radius:
            mass += weight[i]
            centre += (pos[i] - centre) * weight[i] / mass
        else:
            current, centre, mass = current + 1, pos[i], weight[i]
        label[i] = current
    return label


def running_centre_clusters(df: DataFrame, keys: Sequence[str], pos: str, weight: str, member: str, radius: float, width: float) -> DataFrame:
    """Order-dependent 1-D clusters, exactly as the sequential pass makes them.

    A gap wider than the radius always starts a new cluster, because the running
    centre never lies beyond the last member. The rows are cut at such gaps first and
    only one gap-free island at a time goes to a Python group.
    """
    d = df.select(*keys, F.col(pos).cast("double").alias("pos"), F.col(weight).cast("double").alias("weight"), F.col(member).cast("string").alias("member"))
    order = ["pos", "member"]
    x = skew.islands(d, keys, order, skew.span("pos", width), ["pos"], lambda prev, cur: cur["pos"] - prev["pos"] <= radius, "island")
    fields = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = ", ".join([*[f"{k} {fields[k]}" for k in keys], "island bigint", _CLUSTER_SCHEMA])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.assign(cluster_no=_cluster_island(pdf, radius))[[*keys, "island", "cluster_no", "pos", "weight", "member"]]

    return x.groupBy(*keys, "island").applyInPandas(label, schema)


def _two_means(pdf: pd.DataFrame, rounds: int = 12, min_n: int = 6, min_gap: float = 20.0) -> np.ndarray:
    """Side 0 or 1 of each member after a weighted two-centre split from the quartiles; -1 when it does not split."""
    x, w = pdf["pos"].to_numpy(), pdf["weight"].to_numpy()
    none = np.full(len(x), -1, dtype=np.int32)
    if len(x) < min_n:
        return none
    centre = np.quantile(x, [0.25, 0.75])
    if abs(centre[1] - centre[0]) < min_gap:
        return none
    for _ in range(rounds):
        right = np.abs(x - centre[0]) > np.abs(x - centre[1])
        if right.all() or not right.any():
            return none
        moved = np.array([np.average(x[~right], weights=w[~right]), np.average(x[right], weights=w[right])])
        step = np.abs(moved - centre).sum()
        if step < 1e-3:
            break
        centre = moved
    return right.astype(np.int32)


def two_means_split(clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``side`` to the members of each cluster; a cluster is one small group."""
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in clusters.schema.fields], "side int"])

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "member"], kind="stable").reset_index(drop=True)
        return pdf.assign(side=_two_means(pdf))

    return clusters.groupBy(*keys).applyInPandas(split, schema)


def cluster_summary(clusters: DataFrame, keys: Sequence[str], series: str, path_len: int, radius: float, penalty: float) -> DataFrame:
    """Centre, support and evidence score per cluster with its retain or drop reason."""
    c = clusters.groupBy(*keys).agg(F.count_distinct(series).alias("stations"), F.sum("weight").alias("support"),
                                    (F.sum(F.col("pos") * F.col("weight")) / F.sum("weight")).alias("centre"), F.count(F.lit(1)).alias("events"))
    r = clusters.join(c.select(*keys, "centre"), list(keys)).withColumn("dev", F.abs(F.col("pos") - F.col("centre")))
    q = Q.quantiles(r, keys, "dev", radius, {"dev50": 0.5, "dev90": 0.9})
    s = c.join(q, list(keys))
    score = F.col("stations") / F.lit(float(path_len)) * F.log1p("support") * F.exp(-F.col("dev90") / F.greatest(F.lit(1.0), F.lit(radius)))
    return s.withColumn("evidence", score).withColumn("gain", F.col("evidence") - penalty)


def station_phase(predicted: DataFrame, found: DataFrame, station: str, target: str, time: str, max_residual: float, width: float, min_n: int = 3) -> DataFrame:
    """Median residual to the nearest pulse per station, centred by the median over stations."""
    n = J.nearest(predicted, found, [station], target, time, [], max_residual, width, "hit", tie=[time])
    r = n.where("hit is not null").withColumn("res", F.col(f"hit.{time}") - F.col(target))
    enough = r.groupBy(station).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    med = Q.median(r, [station], "res", 30.0, "phase").join(enough, station)
    centre = Q.median(med, [], "phase", 30.0, "c")
    return med.withColumn("phase", F.col("phase") - centre.scalar())


def lattice_scores(z: DataFrame, series: Sequence[str], minute: str, weight: str, offset: str, grid: DataFrame, group: Sequence[str], horizon: int) -> DataFrame:
    """Mean positive weighted z of every (headway, phase) lattice.

    ``z`` has one row per series and minute. A minute belongs to a lattice when its
    offset-corrected time is a multiple of the headway after the phase, so each row meets
    each headway once and the phase is its remainder: no pass per lattice point.
    """
    at = (F.col(minute) - F.col(offset)) if offset else F.col(minute)
    x = z.withColumn("headway", F.explode(grid.agg(F.array_sort(F.collect_set("headway"))).scalar()))
    x = x.withColumn("phase", F.pmod(at, F.col("headway"))).where((at >= 0) & (at < horizon))
    g = x.groupBy(*group, "headway", "phase").agg(F.sum(F.col(weight) * F.greatest(F.col("z"), F.lit(0.0))).alias("num"), F.sum(weight).alias("den"))
    return g.withColumn("score", F.col("num") / F.col("den")).drop("num", "den")


def choose_lattice(scores: DataFrame, group: Sequence[str], expected: float) -> DataFrame:
    rank = F.struct(-F.round("score", 9), F.abs(F.col("headway") - expected), F.col("phase"), F.col("headway"))
    return scores.groupBy(*group).agg(F.min_by("headway", rank).alias("headway"), F.min_by("phase", rank).alias("phase"), F.min_by("score", rank).alias("score"))


def ridge_scores(z: DataFrame, offsets: DataFrame, series: str, minute: str, group: Sequence[str]) -> DataFrame:
    """Weighted mean positive z along a candidate intercept.

    Each observed minute points back at the one intercept it supports, so the
    candidates come from the data; ``offsets`` has series, offset and weight per group.
    """
    total = offsets.groupBy(*group).agg(F.sum("weight").alias("den"))
    x = z.join(offsets, series).withColumn("intercept", F.col(minute) - F.col("offset"))
    g = x.groupBy(*group, "intercept").agg(F.sum(F.col("weight") * F.greatest(F.col("z"), F.lit(0.0))).alias("num"))
    return g.join(total, list(group)).withColumn("score", F.col("num") / F.col("den")).drop("num", "den")


def complete_upstream(anchors: DataFrame, found: DataFrame, steps: Sequence[tuple[int, int, float]], station: str, time: str, score: str,
                      tolerance: float, min_progress: float, width: float) -> DataFrame:
    """Walks each terminal anchor upstream edge by edge.

    ``steps`` lists (upstream station, downstream station, lag). At each step all anchors
    look up their nearest pulse at once; without a match the predicted time stands and the
    variance grows. A step is a written table, so that the plan does not grow with the
    path, and its time line is cut into chunks of ``width`` seconds.
    """
    cur = anchors.select("root", F.col(time).alias("t"), F.lit(0.0).alias("var"))
    out = cur.select("root", F.lit(0).alias("step"), F.lit(steps[0][1]).cast("int").alias(station), F.col("t"), F.lit(True).alias("observed"), F.lit(0.0).alias("sd"))
    for n, (up, _down, lag) in enumerate(steps, start=1):
        here = found.where(F.col(station) == up).select(F.lit(1).alias("__k"), F.col(time).alias("pt"), (-F.col(score)).alias("neg"))
        q = cur.select("root", "t", "var", F.lit(1).alias("__k"), (F.col("t") - lag).alias("pred"), (F.col("t") - min_progress).alias("ub"))
        q = J.nearest(q, here, ["__k"], "pred", "pt", [], tolerance, width, "hit", tie=["neg"], upper="ub")
        hit = F.col("hit").isNotNull() & (F.col("pred") >= 0)
        cur = cut_lineage(q.select("root", F.when(hit, F.col("hit.pt")).otherwise(F.col("pred")).alias("t"), F.when(hit, F.col("var")).otherwise(F.col("var") + 45.0 ** 2).alias("var"), hit.alias("observed")))
        out = out.unionByName(cur.select("root", F.lit(n).alias("step"), F.lit(up).cast("int").alias(station), "t", "observed",
                                         F.when(F.col("observed"), F.lit(20.0)).otherwise(F.greatest(F.lit(60.0), F.sqrt("var"))).alias("sd")))
        cur = cur.drop("observed")
    return out


def progression_prior(clocks: DataFrame, line: str, serial: str, first: str, last: str, observer: str, max_disagree: float, bound: float) -> DataFrame:
    """Run time between neighbouring stations from first and last clocks that agree.

    ``clocks`` has one row per observer, line and station serial; repeated ones are
    ambiguous and left out.
    """
    keys = [observer, line, serial]
    uniq = clocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("f"), F.min(last).alias("l")).where("n = 1").drop("n")
    nxt = uniq.select(observer, line, (F.col(serial) - 1).alias(serial), F.col("f").alias("f2"), F.col("l").alias("l2"))
    j = uniq.join(nxt, keys).withColumns({"df": F.abs(F.col("f2") - F.col("f")), "dl": F.abs(F.col("l2") - F.col("l"))})
    v = j.where(F.abs(F.col("df") - F.col("dl")) <= max_disagree).withColumn("v", (F.col("df") + F.col("dl")) / 2).where((F.col("v") > 0) & (F.col("v") <= bound))
    lin = Q.median(v, [line, serial], "v", 60.0, "med")
    fl = Q.quantiles(v, [line, serial], "v", 60.0, {"p10": 0.1, "p90": 0.9}, kind="floor")
    return v.groupBy(line, serial).agg(F.count(F.lit(1)).alias("n")).join(lin, [line, serial]).join(fl, [line, serial])


def with_fallbacks(df: DataFrame, tiers: Sequence[tuple[str, DataFrame, Sequence[str]]], value: str, out: str, klass: str) -> DataFrame:
    """First tier with a value, and its name. A tier without keys is one global value."""
    picks, label = [], F.lit(None).cast("string")
    for i, (name, table, keys) in enumerate(tiers):
        col = f"__v{i}"
        if keys:
            df = df.join(table.select(*keys, F.col(value).alias(col)), list(keys), "left")
        else:
            df = df.withColumn(col, table.select(value).scalar())
        picks.append(col)
    for (name, _, _), col in reversed(list(zip(tiers, picks))):
        label = F.when(F.col(col).isNotNull(), F.lit(name)).otherwise(label)
    return df.withColumns({out: F.coalesce(*picks), klass: label}).drop(*picks)
