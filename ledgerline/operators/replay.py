"""Replay of travellers without a chain: where a route fails, when they were ready there, and which services could take them up."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.functions import clocks, dist
from ledgerline.operators import joins as J
from ledgerline.operators.assign import _runs, group_span, group_splits
from ledgerline.operators.assign import _pair as pair_number
from ledgerline.session import cut_lineage

# A ride is past a traveller's horizon if it arrives this many sd (of one second at least) after the exit.
HORIZON_SDS, LEAST_SD_S = 3.0, 1.0
#: A choice with less probability is none.
LEAST_PROBABILITY = 1e-12
#: Rides that leave this long before the ready time have no probability, whatever their sd.
EARLY_S = 180

OD = ["from_station", "to_station"]
LEG = ["leg_from", "leg_to"]


def gate(arr: Column, sd: Column) -> Column:
    """Latest exit that a ride's arrival is certainly too late for."""
    return arr.cast("double") - HORIZON_SDS * F.greatest(F.lit(LEAST_SD_S), sd)


def route_failures(cohorts: DataFrame, routes: DataFrame, rides: DataFrame) -> DataFrame:
    """Each cohort and route with the first leg that no ride serves, or whose every ride is past the exit horizon.

    The earliest gate of a leg decides for all its rides, so rides are reduced to one row
    per leg first; a route is then a short array of legs tested in the cohort's row.
    """
    least = rides.groupBy(*[F.col(o).alias(n) for o, n in zip(OD, LEG, strict=True)]).agg(
        F.min(F.struct(gate(F.col("arr"), F.col("sd")).alias("gate"), F.col("ride_id").alias("ride"))).alias("g"))
    legs = routes.join(least, LEG, "left").groupBy(*OD, "route_rank", "cost").agg(F.array_sort(F.collect_list(F.struct(
        "leg_no", *LEG, F.col("g.gate").alias("gate"), F.col("g.ride").alias("ride")))).alias("legs"))
    x = cohorts.join(legs, OD).withColumn("bad", F.filter("legs", lambda s: s["gate"].isNull() | (s["gate"] > F.col("exit")))).withColumn("bad", F.get("bad", F.lit(0)))
    reason = F.when(F.col("bad").isNull(), "FINITE_HARD_CHAIN_EXISTS").when(F.col("bad.gate").isNull(), "MISSING_SERVICE_SEGMENT").otherwise("TIME_INCOMPATIBLE_CHAIN")
    return x.select(*cohorts.columns, "route_rank", "cost", reason.alias("reason"), F.col("bad.leg_no").alias("leg_no"), *[F.col(f"bad.{c}").alias(c) for c in LEG],
                    F.col("bad.ride").alias("closest"), (F.col("bad.gate") - F.col("exit")).alias("excess"))


def boarding_options(rides: DataFrame, skips: int, width: float) -> DataFrame:
    """Each ride as the first in reach: the ride before it, its place among those of its leg (up to ``skips + 1``), and the rides that may be boarded then, itself or one of the next ``skips``.

    Neighbours are looked up in chunks of time, written once. The first and last rides of the chunks
    alone are a short list per leg with the same neighbours across the borders.
    """
    x = rides.select(*[F.col(o).alias(n) for o, n in zip(OD, LEG, strict=True)], "ride_id", "dep", "arr", "sd").withColumn("__chunk", skew.span("dep", width))
    order, edge = ["dep", "ride_id"], max(1, skips)

    def seen(w):
        at = lambda k, name: F.lead(name, k).over(w) if k else F.col(name)
        return {"before_dep": F.lag("dep").over(w), "before_sd": F.lag("sd").over(w), **{f"{name}{k}": at(k, name) for k in range(skips + 1) for name in ("ride_id", "arr", "sd")}}

    own = Window.partitionBy(*LEG, "__chunk").orderBy(*order)
    x = cut_lineage(x.withColumns({**seen(own), "pos": F.row_number().over(own), "__left": F.lead("dep", edge).over(own)}).drop("__chunk"))
    names = [*LEG, "dep", "sd", "pos", "before_dep", "before_sd", *[f"{name}{k}" for k in range(skips + 1) for name in ("ride_id", "arr", "sd")]]
    inner = (F.col("pos") > edge) & F.col("__left").isNotNull()
    across = Window.partitionBy(*LEG).orderBy(*order)
    both = {n: F.coalesce(n, c) for n, c in seen(across).items()}
    border = x.where(~inner).withColumns({**both, "pos": F.row_number().over(across)})
    least = F.least("pos", F.lit(skips + 1)).alias("pos")
    pick = [least if n == "pos" else n for n in names]
    return x.where(inner).select(*pick).unionByName(border.select(*pick))


# First rides in reach that are looked at together in a task.
_BLOCK = 200_000


def _most(upper: np.ndarray, lower: np.ndarray, sd: np.ndarray, kernel: Sequence[tuple]) -> np.ndarray:
    """At least the expected mixture mass between two bounds with sds of at most ``sd`` (lower NaN: none), the error of ``erf`` included: width times the highest density within reach."""
    far = dist.GH_NODES[-1] * sd
    low, high = np.maximum(lower - far, 1e-6), np.maximum(upper + far, 1e-6)
    density = np.zeros(len(upper))
    for w, m, s in kernel:
        x = np.clip(m * math.exp(-s * s), low, high)
        z = (np.log(x) - math.log(m)) / s
        density += w * np.exp(-0.5 * z * z) / (x * s * math.sqrt(2.0 * math.pi))
    return np.where(np.isnan(lower), 1.0, np.minimum(1.0, density * (upper - lower + far))) + 1e-6


def _walk(deepest: int, skips: int, access: Sequence[tuple], transfer: Sequence[tuple], beam: int, columns: Sequence[str]):
    """The states of the travellers of a group at their failing leg, as an Arrow function."""
    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        number_of, pair = np.unique(right["__pair"].to_numpy(), return_inverse=True)
        get = lambda name: right[name].to_numpy(zero_copy_only=False).astype("float64")
        ride0 = right["ride_id0"].to_numpy(zero_copy_only=False)
        order = np.lexsort((ride0, get("dep"), pair))
        pair, dep, sd, pos, before_dep, before_sd = pair[order], *[get(name)[order] for name in ("dep", "sd", "pos", "before_dep", "before_sd")]
        rides = [pc.fill_null(right[f"ride_id{k}"].cast(pa.int64()), -1).to_numpy()[order] for k in range(skips + 1)]
        known = [~right[f"ride_id{k}"].is_null().to_numpy()[order] for k in range(skips + 1)]
        arrs, sds = ([get(f"{name}{k}")[order] for k in range(skips + 1)] for name in ("arr", "sd"))
        gates = [a - HORIZON_SDS * np.maximum(LEAST_SD_S, v) for a, v in zip(arrs, sds, strict=True)]
        low, room = (dep.min() - 1, dep.max() - dep.min() + 3) if len(dep) else (0.0, 3.0)
        line, top_sd = pair * room + dep - low, max(sd.max(initial=0.0), np.nan_to_num(before_sd).max(initial=0.0))
        own = lambda name: left[name].to_numpy(zero_copy_only=False).astype("float64")
        entry, leave, stop = own("entry"), own("exit"), left["leg_no"].to_numpy()
        n_rows = left.num_rows
        n_states, least, mean, most = np.zeros(n_rows, "int64"), np.zeros(n_rows), np.zeros(n_rows), np.zeros(n_rows)
        row, ready, ready_sd, logp = np.arange(n_rows), entry.copy(), np.zeros(n_rows), np.zeros(n_rows)
        for leg in range(1, deepest):
            go = stop[row] > leg
            row, ready, ready_sd, logp = row[go], ready[go], ready_sd[go], logp[go]
            kernel = access if leg == 1 else transfer
            at_pair = pc.fill_null(left[f"__pair{leg}"].cast(pa.int64()), np.iinfo("int64").min).to_numpy()[row]
            i = np.minimum(np.searchsorted(number_of, at_pair), max(len(number_of) - 1, 0))
            served = (number_of[i] == at_pair) if len(number_of) else np.zeros(len(row), bool)
            base = np.where(served, i, 0) * room
            lo = np.searchsorted(line, base + np.clip(ready - EARLY_S - low, 0.0, room - 1), "left")
            hi = np.searchsorted(line, base + np.clip(leave[row] + HORIZON_SDS * 60 - low, 0.0, room - 1), "right")
            n = np.where(served, np.maximum(hi - lo, 0), 0)
            of_row, first, size = np.unique(row, return_index=True, return_counts=True)
            per_row = np.add.reduceat(n, first) if len(first) else np.zeros(0, "int64")
            todo, out = np.argsort(per_row, kind="stable"), []
            todo = todo[per_row[todo] > 0]
            upto = 0
            while upto < len(todo):
                take = max(1, int(np.searchsorted(np.cumsum(per_row[todo[upto:upto + _BLOCK]]), _BLOCK, "right")))
                rows, upto = todo[upto:upto + take], upto + take
                c = _runs(first[rows], size[rows])
                s = np.repeat(c, n[c])
                u = _runs(lo[c], n[c])
                place = np.repeat(np.arange(len(rows)), per_row[rows])
                column = np.arange(len(u)) - (np.cumsum(per_row[rows]) - per_row[rows])[place]

                def scored(some: np.ndarray):
                    x, y = s[some], u[some]  # noqa: B023
                    prob = dist.expected_mixture_values(dep[y] - ready[x], np.sqrt(sd[y] * sd[y] + ready_sd[x] * ready_sd[x]), kernel)  # noqa: B023
                    lower = np.flatnonzero(~np.isnan(before_dep[y]))
                    i, j = x[lower], y[lower]
                    prob[lower] -= dist.expected_mixture_values(before_dep[j] - ready[i], np.sqrt(before_sd[j] * before_sd[j] + ready_sd[i] * ready_sd[i]), kernel)  # noqa: B023
                    fit = np.flatnonzero(prob > LEAST_PROBABILITY)
                    x, y, value, r = x[fit], y[fit], logp[x[fit]] + np.log(prob[fit]), place[some[fit]]  # noqa: B023
                    found = []
                    for k in range(skips + 1):
                        ok = np.flatnonzero(known[k][y] & (gates[k][y] <= leave[row[x]]))  # noqa: B023
                        found.append((r[ok], np.round(value[ok] - np.log(np.minimum(skips + 1, pos[y[ok]] + k)), 9), y[ok], np.full(len(ok), k)))
                    return [np.concatenate(v) for v in zip(*found, strict=True)]

                def worst_of(r: np.ndarray, score: np.ndarray) -> np.ndarray:
                    by = np.argsort(r, kind="stable")
                    count = np.bincount(r, minlength=len(rows))  # noqa: B023
                    table = np.full((len(rows), max(1, count.max())), -np.inf)  # noqa: B023
                    table[r[by], np.arange(len(r)) - (np.cumsum(count) - count)[r[by]]] = score[by]
                    return np.partition(table, -beam, axis=1)[:, -beam] if table.shape[1] > beam else np.full(len(rows), -np.inf)  # noqa: B023

                # the most that each can have; those of the highest first, then all that could still reach the beam
                most_sd = np.sqrt(top_sd * top_sd + ready_sd[s] * ready_sd[s])
                can = logp[s] + np.log(_most(dep[u] - ready[s], before_dep[u] - ready[s], most_sd, kernel)) - np.log(np.minimum(skips + 1, pos[u])) + 1e-8
                few = 2 * beam
                table = np.full((len(rows), per_row[rows].max()), -np.inf)
                table[place, column] = can
                level = np.partition(table, -few, axis=1)[:, -few] if table.shape[1] > few else np.full(len(rows), -np.inf)
                likely = can >= level[place]
                part = scored(np.flatnonzero(likely))
                rest = np.flatnonzero(~likely & (can >= worst_of(part[0], part[1])[place]))
                r, score, u, skip = (np.concatenate(v) for v in zip(part, scored(rest), strict=True))
                by_row = np.argsort(r, kind="stable")
                r, score, u, skip = r[by_row], score[by_row], u[by_row], skip[by_row]
                if not len(r):
                    continue
                worst = worst_of(r, score)
                keep = np.flatnonzero(score >= worst[r])
                r, score, u, skip = r[keep], score[keep], u[keep], skip[keep]
                pick = lambda lists: np.choose(skip, [v[u] for v in lists])  # noqa: B023, E731
                arr, ride, ride_sd = pick(arrs), pick(rides), pick(sds)
                best = np.lexsort((skip, ride, arr, -score, r))
                best = best[np.arange(len(best)) - np.searchsorted(r[best], r[best], "left") < beam]
                out.append((of_row[rows[r[best]]], arr[best], ride_sd[best], score[best]))
            row, ready, ready_sd, logp = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, t) for t in ("i8", "f8", "f8", "f8"))
            by_row = np.argsort(row, kind="stable")
            row, ready, ready_sd, logp = (v[by_row] for v in (row, ready, ready_sd, logp))
            at, begin = np.unique(row, return_index=True)
            if len(at):
                after = ready - entry[row]
                top = np.repeat(np.maximum.reduceat(logp, begin), np.diff(np.append(begin, len(row))))
                p = np.exp(logp - top)
                here = stop[at] == leg + 1
                at = at[here]
                pieces = (np.add.reduceat(np.ones(len(row), "int64"), begin), np.minimum.reduceat(after, begin), np.add.reduceat(p * after, begin) / np.add.reduceat(p, begin), np.maximum.reduceat(after, begin))
                for held, v in zip((n_states, least, mean, most), pieces, strict=True):
                    held[at] = v[here]
        out = left.select(list(columns))
        none = n_states == 0
        for name, v in (("n_states", n_states), ("q05", least), ("q50", mean), ("q95", most)):
            out = out.append_column(name, pa.array(v, mask=none))
        return out

    return walk


def replay(failures: DataFrame, routes: DataFrame, options: DataFrame, access: Sequence[tuple], transfer: Sequence[tuple], beam: int, upper: float, width: int = 30 * clocks.DAY_S) -> DataFrame:
    """Ready-time envelope at the failing leg: ``n_states, q05, q50, q95`` in seconds after the entry, null where no chain gets there.

    The beam walks the legs before the failing one, at any depth: a ride counts with the
    probability that it was the first in reach, rides past the exit horizon do not. Travellers meet
    the rides of all their legs once, in spans of time, and only their envelopes leave the task; rides that
    are in reach first are scored once for all rides that may be boarded then. Routes that fail on their
    first leg need no ride. Failures are read more than once, so hand over written ones.
    """
    spark, start = failures.sparkSession, failures.where("leg_no is not null")
    names = failures.columns
    skips = sum(c.startswith("ride_id") for c in options.columns) - 1
    deepest, count, longest = start.agg(F.max("leg_no"), F.count(F.lit(1)), F.max(F.col("exit") - F.col("entry"))).first()
    deepest = deepest or 0
    # six numbers, found once rather than in every row
    ends = {n: [float(v) for v in spark.range(1).select(*[dist.mixture_quantile(k, q, upper).alias(f"q{i}") for i, q in enumerate((0.05, 0.5, 0.95))]).first()] for n, k in (("access", access), ("transfer", transfer))}
    held = start.where("leg_no = 1").select(*names, F.lit(1).cast("bigint").alias("n_states"), *[F.lit(v).alias(q) for q, v in zip(QUANTILES, ends["access"], strict=True)])
    if deepest <= 1:
        return held
    pairs = [f"__pair{k}" for k in range(1, deepest)]
    wide = routes.groupBy(*OD, "route_rank").agg(*[F.max(F.when(F.col("leg_no") == k, pair_number(*LEG))).alias(p) for k, p in enumerate(pairs, 1)])
    ride = options.withColumn("__pair", pair_number(*LEG)).drop(*LEG).where("dep is not null")
    n_rides, first, last, back = ride.agg(F.count(F.lit(1)), F.min("dep"), F.max("dep"), F.min(F.col("arr0") - F.col("dep"))).first()
    before = math.ceil(EARLY_S * deepest - min(back or 0, 0) * deepest)
    reach = max(math.ceil((longest or 0) + before + HORIZON_SDS * 60), before)
    span = group_span(spark, n_rides + count, first, last, reach, width)
    part = F.pmod(F.xxhash64(*OD), F.lit(group_splits(span, (ride, "dep"), (start, "entry")))).alias("__s")
    left = start.where("leg_no > 1").join(wide, [*OD, "route_rank"], "left").withColumns({"__b": F.floor((F.col("entry") - before) / span), "__s": part})
    need = cut_lineage(routes.select(pair_number(*LEG).alias("__pair"), part).distinct())
    right = ride.join(need, "__pair").withColumn("__b", F.explode(F.sequence(F.floor((F.col("dep") - reach) / span), F.floor(F.col("dep") / span))))
    kinds = dict(failures.dtypes)
    ddl = ", ".join(f"{n} {kinds[n]}" for n in names) + ", n_states bigint, q05 double, q50 double, q95 double"
    x = left.groupBy("__b", "__s").cogroup(right.groupBy("__b", "__s")).applyInArrow(_walk(deepest, skips, access, transfer, beam, names), ddl)
    return held.unionByName(x.withColumns({q: F.col(q) + v for q, v in zip(QUANTILES, ends["transfer"], strict=True)}))


QUANTILES = ("q05", "q50", "q95")


def service_support(services: DataFrame, records: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Mass of the records that each service could take up: it leaves when they are ready (at each quantile) and arrives by their exit.

    Services are (keys, ride_id, dep, arr), records (keys, q05, q50, q95, exit, mass), all
    times absolute. Ready by ``dep`` and out after ``arr`` is ready by ``dep``, less out
    before ``arr``, plus ready and out while the service runs: two running sums over one
    time line and a join that is as long as the services are, in place of all pairs.
    """
    t = lambda kind, at, side, **cols: F.struct(F.lit(kind).alias("kind"), at.cast("double").alias("at"), F.lit(side).alias("side"), *[c.cast("bigint").alias(n) for n, c in cols.items()])
    zero, one = F.lit(0), F.lit(1)
    names = ["ride_id", "x_all", *[f"{p}_{q}" for q in QUANTILES for p in ("r", "x", "c", "d")]]
    blank = {n: zero for n in names}
    mass = lambda q: F.when(F.col(q) <= F.col("exit"), F.col("mass")).otherwise(0)
    has = lambda q: F.when(F.col(q) <= F.col("exit"), one).otherwise(0)
    ready = [t("ready", F.col(q), 2, **{**blank, f"r_{q}": mass(q), f"c_{q}": has(q)}) for q in QUANTILES]
    out = t("exit", F.col("exit"), 1, **{**blank, "x_all": F.col("mass"), **{f"x_{q}": mass(q) for q in QUANTILES}, **{f"d_{q}": has(q) for q in QUANTILES}})
    points = records.select(*keys, F.explode(F.array(*ready, out)).alias("p"))
    ends = services.select(*keys, F.explode(F.array(t("dep", F.col("dep"), 3, **{**blank, "ride_id": F.col("ride_id")}), t("arr", F.col("arr"), 0, **{**blank, "ride_id": F.col("ride_id")}))).alias("p"))
    line = points.unionByName(ends).select(*keys, "p.*").withColumn("__id", F.monotonically_increasing_id())
    folds = {f"s_{n}": ("sum", n) for n in names if n != "ride_id"}
    run = cut_lineage(skew.running(line, keys, ["at", "side", "__id"], skew.span("at", width), folds, totals={"all_mass": ("sum", "x_all")}))
    pick = lambda kind, n: F.max(F.when(F.col("kind") == kind, F.col(f"s_{n}")))
    sums = run.where("kind in ('dep', 'arr')").groupBy(*keys, "ride_id").agg(
        (F.max("all_mass") - pick("arr", "x_all")).alias("exit_mass"),
        *[(pick("dep", f"r_{q}") - pick("arr", f"x_{q}")).alias(f"m_{q}") for q in QUANTILES], *[(pick("dep", f"c_{q}") - pick("arr", f"d_{q}")).alias(f"n_{q}") for q in QUANTILES])
    each = records.select(*keys, "exit", "mass", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(q).alias("ready")) for q in QUANTILES])).alias("z")).select(*keys, "exit", "mass", "z.*")
    inside = J.interval_join(services.select(*keys, "ride_id", "dep", "arr"), each.where("ready <= exit"), keys, "dep", "arr", "ready", clocks.DAY_S).where("ready > dep and exit < arr")
    extra = inside.groupBy(*keys, "ride_id").agg(*[F.sum(F.when(F.col("q") == q, F.col("mass")).otherwise(0)).alias(f"i_{q}") for q in QUANTILES],
                                                 *[F.sum(F.when(F.col("q") == q, 1).otherwise(0)).alias(f"k_{q}") for q in QUANTILES])
    x = sums.join(extra, [*keys, "ride_id"], "left")
    return x.select(*keys, "ride_id", "exit_mass", *[(F.col(f"m_{q}") + F.coalesce(f"i_{q}", zero)).alias(f"{q}_mass") for q in QUANTILES],
                    *[(F.col(f"n_{q}") + F.coalesce(f"k_{q}", zero)).alias(f"{q}_cohorts") for q in QUANTILES])


def qualify_segments(records: DataFrame, support: DataFrame, keys: Sequence[str], least_share: float, least_pairs: int) -> DataFrame:
    """Pressure of each segment and its best service; a trial needs ``least_share`` of the mass ready at the median and ``least_pairs`` station pairs."""
    seg = records.groupBy(*keys).agg(F.sum("mass").alias("pressure"), F.count(F.lit(1)).alias("cohorts"), F.count_distinct(*OD).alias("od_pairs"))
    rank = F.struct(-F.col("q50_mass"), -F.col("q95_mass"), -F.col("exit_mass"), "ride_id")
    best = support.groupBy(*keys).agg(F.count(F.lit(1)).alias("services"), F.min_by(F.struct("ride_id", "exit_mass", "q05_mass", "q50_mass", "q95_mass"), rank).alias("b")).select(*keys, "services", "b.*")
    x = seg.join(best, keys, "left").withColumn("services", F.coalesce("services", F.lit(0).cast("bigint")))
    share = lambda c: F.coalesce(F.col(c) / F.col("pressure"), F.lit(0.0))
    return x.withColumns({"q50_share": share("q50_mass"), "q95_share": share("q95_mass")}).withColumn("trial", (F.col("q50_share") >= least_share) & (F.col("od_pairs") >= least_pairs))
