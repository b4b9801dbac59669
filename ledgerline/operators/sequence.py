"""Pairing, stitching, gap and interpolation operators on ordered events.

All of them take a ``chunk`` column expression (see ``ledgerline.skew``), so that
a card, station or line holding a large part of all events is still spread.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.operators import quantiles as Q
from ledgerline.session import cut_lineage

# Longest journey of the status form, of the fare form, longest stitch gap.
MAX_STATUS_JOURNEY_S = 8 * 3600
MAX_FARE_JOURNEY_S = 6 * 3600
MAX_STITCH_GAP_S = 1800


def pair_entry_exit(df: DataFrame, user: str, order: Sequence[str], time_us: str, status: str, fields: Sequence[str],
                    chunk: Column, max_s: int = MAX_STATUS_JOURNEY_S, entry: int = 1, exit_: int = 0) -> DataFrame:
    """Exits whose previous event of any status is an entry, within the longest duration.

    The user key is left out of the result.
    """
    x = skew.neighbour(df, [user], order, chunk, [*fields, time_us, status], "__prev")
    dur = F.col(time_us) - F.col(f"__prev.{time_us}")
    hit = (F.col(status) == exit_) & (F.col(f"__prev.{status}") == entry) & (dur >= 0) & (dur <= max_s * 1_000_000)
    return x.where(hit).select(*[F.col(f"__prev.{f}").alias(f"entry_{f}") for f in fields], F.col(f"__prev.{time_us}").alias("entry_us"),
                               *[F.col(f).alias(f"exit_{f}") for f in fields], F.col(time_us).alias("exit_us"), dur.alias("duration_us"))


def exactly_two(df: DataFrame, user: str, order: Sequence[str], status: str, time_us: str, fields: Sequence[str]) -> DataFrame:
    """Users with exactly two events, entry then exit, as one row each: plain map-side aggregates."""
    row = F.struct(*order, *[c for c in [*fields, time_us, status] if c not in order])
    g = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("a"), F.max(row).alias("b"))
    g = g.where((F.col("n") == 2) & (F.col(f"a.{status}") == 1) & (F.col(f"b.{status}") == 0))
    return g.select(*[F.col(f"a.{f}").alias(f"entry_{f}") for f in fields], *[F.col(f"b.{f}").alias(f"exit_{f}") for f in fields],
                    (F.col(f"b.{time_us}") - F.col(f"a.{time_us}")).alias("duration_us"))


def repeated_times(time: str, out: str = "repeated"):
    """Flags events that share their timestamp with another event of the user.

    Equal timestamps lie next to each other in one chunk, so this is a chunk-local fact.
    """
    def add(df: DataFrame, w: WindowSpec) -> DataFrame:
        t = F.col(time)
        same = F.coalesce(F.lag(t).over(w) == t, F.lit(False)) | F.coalesce(F.lead(t).over(w) == t, F.lit(False))
        return df.withColumn(out, same)
    return add


def drop_blocked(df: DataFrame, blocked: DataFrame, user: str) -> DataFrame:
    """Removes every event of a user that has an event which cannot be ordered."""
    return df.join(blocked.select(user).distinct(), user, "left_anti")


def barrier_pairs(df: DataFrame, user: str, time_s: str, seq: str, kind: str, fields: Sequence[str], chunk: Column,
                  max_s: int = MAX_FARE_JOURNEY_S) -> DataFrame:
    """Entry-exit segments with barriers.

    ``kind`` is ENTRY, EXIT or anything else for a barrier. An open entry is
    replaced by a newer entry and closed by a barrier or a repeated timestamp, so an
    exit pairs exactly when the event right before it is a clean entry. Events are
    numbered within the user (``entry_pos``, ``exit_pos``) for adjacency checks.
    """
    def roles(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = repeated_times(time_s)(d, w)
        return d.withColumn("__role", F.when(F.col("repeated"), F.lit("BARRIER")).otherwise(F.col(kind)))

    x = df.withColumn("__one", F.lit(1).cast("bigint"))
    x = skew.chunked(x, [user], [time_s, seq], chunk, local=roles, folds={"__pos": ("sum", "__one", False)},
                     near={"__prev": ([*fields, time_s, "__role"], False)})
    dur = F.col(time_s) - F.col(f"__prev.{time_s}")
    hit = (F.col("__role") == "EXIT") & (F.col("__prev.__role") == "ENTRY") & (dur <= max_s)
    return x.where(hit).select(user, *[F.col(f"__prev.{f}").alias(f"entry_{f}") for f in fields], F.col(f"__prev.{time_s}").alias("entry_s"),
                               (F.col("__pos") - 1).alias("entry_pos"), *[F.col(f).alias(f"exit_{f}") for f in fields],
                               F.col(time_s).alias("exit_s"), F.col("__pos").alias("exit_pos"))


@dataclass(frozen=True)
class TransferRule:
    """A transfer outside the gates: at one station, between pairs of lines, within a time and a range of days."""

    station: int | str
    line_pairs: Sequence[tuple[int | str, int | str]]
    first_day: int
    last_day: int | None = None
    max_gap_s: int = MAX_STITCH_GAP_S


def transfer_rule(rules: Sequence[TransferRule]) -> Callable[[Column, Column], Column]:
    """Rule for ``stitch``: the exit and next entry are at one station, their lines are a pair of it in
    either order, the gap is positive and within the rule's, and the day of the entry is in its range."""
    table = [(r, tuple(p)) for r in rules for p in r.line_pairs]

    def joins(prev: Column, cur: Column) -> Column:
        gap, day = cur["entry_s"] - prev["exit_s"], F.floor(cur["entry_s"] / 86400)
        hit = F.lit(False)
        if table:
            rows = F.array(*[F.struct(F.lit(r.station).alias("station"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(r.max_gap_s).alias("gap"), F.lit(r.first_day).alias("lo"),
                                      F.lit(r.last_day).cast("int").alias("hi")) for r, (a, b) in table])
            hit = F.exists(rows, lambda r: (r["station"] == cur["entry_station"]) & (gap <= r["gap"]) & (day >= r["lo"]) & (r["hi"].isNull() | (day <= r["hi"]))
                           & (((r["a"] == prev["exit_line"]) & (r["b"] == cur["entry_line"])) | ((r["b"] == prev["exit_line"]) & (r["a"] == cur["entry_line"]))))
        return (prev["exit_station"] == cur["entry_station"]) & (gap > 0) & F.coalesce(hit, F.lit(False))
    return joins


def stitch(segments: DataFrame, user: str, chunk: Column, rule: Callable[[Column, Column], Column], fields: Sequence[str]) -> DataFrame:
    """Journeys of consecutive segments that a transfer rule joins.

    ``rule`` gets the earlier and the later segment as structs. Segments must also be
    adjacent in the source events.
    """
    seen = [*[f"entry_{f}" for f in fields], *[f"exit_{f}" for f in fields], "entry_s", "entry_pos", "exit_s", "exit_pos"]
    x = skew.islands(segments, [user], ["entry_s", "entry_pos"], chunk, seen,
                     lambda prev, cur: rule(prev, cur) & (cur["entry_pos"] == prev["exit_pos"] + 1), "__journey")
    first, last = F.struct("entry_s", "entry_pos"), F.struct("exit_s", "exit_pos")
    return (x.groupBy(user, "__journey").agg(
        *[F.min_by(f"entry_{f}", first).alias(f"entry_{f}") for f in fields], F.min("entry_s").alias("entry_s"),
        *[F.max_by(f"exit_{f}", last).alias(f"exit_{f}") for f in fields], F.max("exit_s").alias("exit_s"),
        (F.count(F.lit(1)) - 1).alias("transfers")).drop(user, "__journey"))


def consecutive_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str) -> DataFrame:
    """Drops repeats of the same value in a row."""
    x = skew.neighbour(df, keys, order, chunk, [value], "__prev")
    return x.where(F.col("__prev").isNull() | ~F.col(f"__prev.{value}").eqNullSafe(F.col(value))).drop("__prev")


def canonical_sequence(stops: DataFrame, route: str, trip: str, seq: str, stop: str) -> DataFrame:
    """First visits along each route's canonical trip: most distinct stops, then longest, then smallest id."""
    per_stop = stops.groupBy(route, trip, stop).agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias("__v"))
    size = per_stop.groupBy(route, trip).agg(F.count(F.lit(1)).alias("__d"), F.sum("__v").alias("__l"))
    best = size.groupBy(route).agg(F.min_by(trip, F.struct(-F.col("__d"), -F.col("__l"), F.col(trip))).alias(trip))
    return per_stop.join(best, [route, trip]).drop("__v")


def next_gap(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, time: str, out: str) -> DataFrame:
    """Time to the next row of the key."""
    x = skew.neighbour(df, keys, order, chunk, [time], "__next", following=True)
    return x.withColumn(out, F.col(f"__next.{time}") - F.col(time)).drop("__next")


def interpolate(df: DataFrame, keys: Sequence[str], position: str, value: str, chunk: Column, out: str, tie: Sequence[str] = ()) -> DataFrame:
    """Linear fill between the known neighbours; the nearest known value outside them. ``tie`` orders rows at the same position."""
    x = df.withColumn("__k", F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v"))))
    x = skew.chunked(x, keys, [position, *tie], chunk, known={"__a": ("__k", False, False), "__b": ("__k", True, False)})
    a, b = F.col("__a"), F.col("__b")
    mid = a["v"] + (b["v"] - a["v"]) * (F.col(position) - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0))
    return x.withColumn(out, F.coalesce(F.col(value), mid, a["v"], b["v"])).drop("__k", "__a", "__b")


def forward_floor(df: DataFrame, keys: Sequence[str], position: str, value: str, gap: float, chunk: Column, out: str) -> DataFrame:
    """Pushes values forward so that each is at least ``gap`` after its predecessor.

    Closed form of the sequential pass: running maximum of value - i*gap, plus i*gap.
    """
    x = df.withColumn("__lift", F.col(value) - F.col(position) * gap)
    x = skew.running(x, keys, [position], chunk, {"__top": ("max", "__lift")})
    return x.withColumn(out, F.col("__top") + F.col(position) * gap).drop("__lift", "__top")


def shrink(target: Column, old: Column, weight: Column, prior: float) -> Column:
    """Blend of a target with the old value by weight/(weight+prior)."""
    return target * (weight / (weight + prior)) + old * (F.lit(prior) / (weight + prior))


def increasing_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column) -> DataFrame:
    """Keeps the keys whose values strictly increase along the order."""
    x = skew.neighbour(df, keys, order, chunk, [value], "__prev")
    bad = x.where(F.col(value) <= F.col(f"__prev.{value}")).select(*keys).distinct()
    return df.join(bad, list(keys), "left_anti")


# Uncertainty of a filled stop grows by 25 s per unit of distance from 30 s, up to 600 s; run times per edge that count, and the one without any.
FILL_BASE_S, FILL_STEP_S, FILL_MAX_S = 30, 25, 600
EDGE_LEAST_S, EDGE_MOST_S, EDGE_DEFAULT_S = 30, 300, 121.0
# Largest event offset, least gap between events of a root, prior weight of its old offsets.
OFFSET_MOST_S, EVENT_GAP_S, OFFSET_PRIOR = 180.0, 1.0, 300.0


def _middle(values: Column) -> Column:
    """Median of a short sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2.0


def observed_stops(events: DataFrame, trip: str, line: str, pos: str, time: str) -> DataFrame:
    """One row per trip with its observed stops as an array in corridor order; a trip has at most one stop for each position."""
    return events.groupBy(trip, line).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(time).cast("double").alias("t")))).alias("obs"))


def edge_times(stops: DataFrame, line: str, width: float = 10.0) -> DataFrame:
    """Median run time per edge of each line, from neighbouring observed stops; lines without one take that of all lines."""
    pair = F.zip_with(F.slice("obs", 1, F.size("obs") - 1), F.slice("obs", 2, F.size("obs")), lambda a, b: F.abs(b["t"] - a["t"]) / (b["p"] - a["p"]))
    each = cut_lineage(stops.select(line, F.explode(pair).alias("per")).where(F.col("per").between(EDGE_LEAST_S, EDGE_MOST_S)))
    own, whole = Q.median(each, [line], "per", width, "per"), Q.median(each, [], "per", width, "per")
    lines = stops.select(line).distinct()
    return lines.join(own, line, "left").select(line, F.coalesce("per", F.coalesce(whole.scalar(), F.lit(EDGE_DEFAULT_S))).alias("per_edge"))


def complete_trips(events: DataFrame, trip: str, line: str, pos: str, time: str, lo: int, hi: int) -> DataFrame:
    """Every corridor position of each trip: ``trip, pos, filled, uncertainty, original``.

    Observed stops stay as they are. The others lie on a line with the run time per edge
    of the trip's line through the median of the intercepts that the observed stops give.
    Trips with one stop only are left as they are. One shuffle brings the stops of a trip
    together; all else happens in its row.
    """
    stops = cut_lineage(observed_stops(events, trip, line, pos, time))
    x = stops.join(edge_times(stops, line), line)
    first, last = F.get("obs", F.lit(0)), F.element_at("obs", -1)
    x = x.withColumns({"sign": F.when(last["t"] >= first["t"], 1.0).otherwise(-1.0), "ref": _middle(F.transform("obs", lambda o: o["p"].cast("double")))})
    x = x.withColumn("at", _middle(F.array_sort(F.transform("obs", lambda o: o["t"] - F.col("sign") * (o["p"] - F.col("ref")) * F.col("per_edge")))))
    reach = F.sequence(F.least(F.lit(lo).cast("bigint"), first["p"].cast("bigint")), F.greatest(F.lit(hi).cast("bigint"), last["p"].cast("bigint")))
    asked = F.when(F.size("obs") >= 2, reach).otherwise(F.transform("obs", lambda o: o["p"].cast("bigint")))
    y = x.select(trip, "obs", "sign", "ref", "at", "per_edge", F.explode(asked).alias(pos))
    own = F.get(F.filter("obs", lambda o: o["p"] == F.col(pos)), F.lit(0))["t"]
    near = F.array_min(F.transform("obs", lambda o: F.abs(o["p"] - F.col(pos))))
    filled = F.coalesce(own, F.col("at") + F.col("sign") * (F.col(pos) - F.col("ref")) * F.col("per_edge"))
    unc = F.when(own.isNotNull(), 0).otherwise(F.least(F.lit(FILL_MAX_S), FILL_BASE_S + FILL_STEP_S * near))
    return y.select(trip, pos, filled.alias("filled"), unc.cast("bigint").alias("uncertainty"), own.isNotNull().alias("original"))


def complete_variants(events: DataFrame, variants: DataFrame, trip: str, line: str, node: str, time: str, base_s: float) -> DataFrame:
    """Completions that keep every observed event: ``trip, variant, node, filled, uncertainty, role``.

    ``variants`` has (line, variant, i, node, cum): the nodes of each corridor variant in
    order with their distance from its start. A variant counts for a trip of two stops or
    more if it holds all its stops and they come at rising places in the order of time.
    Between two observed stops time goes with distance, outside them by the run time per
    unit that the observed stops of the line have.
    """
    paths = variants.groupBy(line, "variant").agg(F.array_sort(F.collect_list(F.struct("i", F.col("node").alias("n"), F.col("cum").cast("double").alias("c")))).alias("path"))
    seen = cut_lineage(observed_stops(events, trip, line, node, time).where(F.size("obs") >= 2))
    # a row per line or variant: a shuffle by line would leave as many tasks as lines
    x = seen.join(F.broadcast(edge_times(seen, line)), line).join(F.broadcast(paths), line)
    place = lambda n: F.get(F.filter("path", lambda q: q["n"] == n), F.lit(0))
    # places are looked up once for each trip and variant; only those rows are written, the nodes are unfolded on reading
    x = cut_lineage(x.select(trip, line, "variant", "per_edge", F.array_sort(F.transform("obs", lambda o: F.struct(o["t"].alias("t"), place(o["p"]).alias("at")))).alias("on")))
    rising = F.forall(F.zip_with(F.slice("on", 1, F.size("on") - 1), F.slice("on", 2, F.size("on")), lambda a, b: F.coalesce((a["t"] < b["t"]) & (a["at"]["i"] < b["at"]["i"]), F.lit(False))), lambda ok: ok)
    x = x.where(rising & F.forall("on", lambda o: o["at"].isNotNull())).join(F.broadcast(paths), [line, "variant"]).select(trip, "variant", "per_edge", "on", F.explode("path").alias("q"))
    i, c = F.col("q.i"), F.col("q.c")
    x = x.withColumns({"own": F.get(F.filter("on", lambda o: o["at"]["i"] == i), F.lit(0)), "left": F.try_element_at(F.filter("on", lambda o: o["at"]["i"] < i), F.lit(-1)),
                       "right": F.get(F.filter("on", lambda o: o["at"]["i"] > i), F.lit(0))})
    lc, rc, lt, rt = F.col("left.at.c"), F.col("right.at.c"), F.col("left.t"), F.col("right.t")
    share = F.when(rc - lc <= 1e-9, 0.5).otherwise((c - lc) / (rc - lc))
    filled = F.coalesce(F.col("own.t"), lt + share * (rt - lt), lt + (c - lc) * F.col("per_edge"), rt - (rc - c) * F.col("per_edge"))
    far = F.least(c - lc, rc - c)
    unc = F.when(F.col("own").isNotNull(), base_s).otherwise(F.least(F.lit(float(FILL_MAX_S)), F.greatest(F.lit(float(base_s)), FILL_BASE_S + FILL_STEP_S * far)))
    role = (F.when(F.col("own").isNotNull(), "ORIGINAL").when(F.col("left").isNotNull() & F.col("right").isNotNull(), "BETWEEN_OBSERVED_ANCHORS")
            .when(F.col("left").isNotNull(), "EXTRAPOLATED_AFTER_LAST_OBSERVED").otherwise("EXTRAPOLATED_BEFORE_FIRST_OBSERVED"))
    return x.select(trip, "variant", F.col("q.n").alias(node), filled.alias("filled"), unc.alias("uncertainty"), role.alias("role"))


def repair_offsets(events: DataFrame, root: str, seq: str, time: str, old: str, direct: str, weight: str) -> DataFrame:
    """New offsets of a root's events: ``root, seq, offset, repaired``.

    Direct offsets are interpolated over the event numbers, the nearest one holds outside
    them; the blend with the old offsets goes by the largest weight of the root; then
    events are pushed apart in order. A root without direct offsets keeps its old ones.
    """
    clip = lambda c: F.greatest(F.lit(-OFFSET_MOST_S), F.least(F.lit(OFFSET_MOST_S), c))
    x = interpolate(events, [root], seq, direct, None, "__i")
    x = skew.chunked(x.withColumn("__w0", F.when(F.col(direct).isNotNull(), F.col(weight))), [root], [seq], None, totals={"__w": ("max", "__w0")})
    alpha = F.col("__w") / (F.col("__w") + OFFSET_PRIOR)
    x = x.withColumn("__v", clip(alpha * F.col("__i") + (F.lit(1.0) - alpha) * F.col(old))).withColumn("__t", F.col(time) + F.col("__v"))
    x = forward_floor(x, [root], seq, "__t", EVENT_GAP_S, None, "__fixed")
    offset = F.when(F.col("__w").isNull(), F.col(old)).otherwise(clip(F.col("__fixed") - F.col(time)))
    return x.select(root, seq, offset.alias("offset"), (F.col("__w").isNotNull() & (F.col("__fixed") > F.col("__t") + 1e-9)).alias("repaired"))


def bracketed_times(events: DataFrame, unique_paths: DataFrame, trip: str, node: str, time: str, chunk: Column) -> DataFrame:
    """Times at stops that were observed, or lie on the only shortest path between two neighbouring observations.

    ``unique_paths`` has (source, target, node, pos, length) for pairs with a single
    shortest path. Of several brackets the tightest in time counts.
    """
    e = events.select(trip, F.col(node).alias("node"), F.col(time).alias("t"))
    x = skew.neighbour(e, [trip], ["t", "node"], chunk, ["node", "t"], "nx", following=True).where("nx is not null")
    b = x.select(trip, F.col("node").alias("source"), F.col("nx.node").alias("target"), F.col("t").alias("t0"), F.col("nx.t").alias("t1"))
    p = b.join(unique_paths, ["source", "target"]).where("pos > 0 and pos < length")
    p = p.select(trip, "node", (F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("pos") / F.col("length")).alias("at"), (F.col("t1") - F.col("t0")).alias("slack"), F.lit(False).alias("exact"))
    o = e.select(trip, "node", F.col("t").cast("double").alias("at"), F.lit(0).cast(p.schema["slack"].dataType).alias("slack"), F.lit(True).alias("exact"))
    return p.unionByName(o).groupBy(trip, "node").agg(F.min_by(F.struct("at", "exact"), F.struct(~F.col("exact"), "slack", "at")).alias("b")).select(trip, "node", "b.*")
