"""Failed travellers replayed: clock shifts, event pressure, ready times at the failing leg, exit horizons and the services that could help.

Routes have one to four legs over tracks, one of which no ride serves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import clocks, dist
from ledgerline.operators import assign as B
from ledgerline.operators import joins as J
from ledgerline.operators import replay as RP
from ledgerline.plans.assign import CHAIN, IDX, LROUTES, MONTH_S, _chain_sql, chosen, cohorts, evaluated, line_routes, platform_rides
from ledgerline.plans.scalars import lncdf_sql
from ledgerline.plans.views import RIDERS, RIDES
from ledgerline.registry import query, staged
from ledgerline.session import cut_lineage

SHIFT_SCAN = [-3600, -1800, 0, 1800, 3600]


@query("B34_clock_shift_scan", f"""
WITH {RIDES}, {RIDERS}, {LROUTES}, {IDX}, moved AS (SELECT *, unnest({SHIFT_SCAN}) AS shift FROM riders),
 {_chain_sql("moved", kept="rider_id, shift, mass, entry, exit, f, t, route_rank, legs", entry="entry+shift", exit_="exit+shift")},
 best AS (SELECT rider_id, shift, max(mass) AS mass, bool_or(reason='FEASIBLE_COMPLETE_CHAIN') AS ok FROM ev GROUP BY ALL)
SELECT shift::INT AS shift, sum(CASE WHEN ok THEN mass ELSE 0 END)::BIGINT AS resolved_mass, sum(mass)::BIGINT AS mass FROM best GROUP BY 1""")
def _(t):
    """Mass that some route resolves when the tap clock is moved, whatever its number of legs."""
    moved = cohorts(t).withColumn("shift", F.explode(F.array(*[F.lit(s) for s in SHIFT_SCAN]))).withColumns({c: F.col(c) + F.col("shift") for c in ("entry", "exit")})
    e = B.earliest_chains(moved, line_routes(t), platform_rides(t), clocks.DAY_S)
    best = e.groupBy("cohort", "shift").agg(F.max("mass").alias("mass"), F.bool_or("ok").alias("ok"))
    return best.groupBy("shift").agg(F.sum(F.when(F.col("ok"), F.col("mass")).otherwise(0)).alias("resolved_mass"), F.sum("mass").alias("mass"))


REGION_S = 3600
PRESSURE = ["protect_minus", "protect_plus", "resolvable_minus", "resolvable_plus", "minus_seconds"]
_SUMS = ", ".join(f"coalesce(sum(mass) FILTER (kind='{k}'), 0)::BIGINT AS {k}" for k in PRESSURE)


@query("B35_event_pressure", f"""
WITH {CHAIN}, ok AS (SELECT * FROM ch WHERE reason='FEASIBLE_COMPLETE_CHAIN'), links AS (SELECT *, unnest(range(1,len(bs))) AS i FROM ok),
 prev AS (SELECT from_station, to_station, dep, max((dep, arr, ride_id)) AS p FROM tr GROUP BY ALL),
 missed AS (SELECT c.mass, c.ready-d.p[1] AS missed, d.p[3] AS ride FROM ch c ASOF JOIN prev d ON d.from_station=c.leg_from AND d.to_station=c.leg_to AND d.dep<c.ready WHERE reason LIKE '%NO%SERVICE'),
 p AS (SELECT bs[1]['r'] AS ride, 'departure' AS event, 'protect_minus' AS kind, mass FROM ok WHERE bs[1]['d']-entry-15<{REGION_S}
  UNION ALL SELECT bs[-1]['r'], 'arrival', 'protect_plus', mass FROM ok WHERE exit-bs[-1]['a']-15<{REGION_S}
  UNION ALL SELECT bs[i]['r'], 'arrival', 'protect_plus', mass FROM links WHERE bs[i+1]['d']-bs[i]['a']-5<{REGION_S}
  UNION ALL SELECT bs[i+1]['r'], 'departure', 'protect_minus', mass FROM links WHERE bs[i+1]['d']-bs[i]['a']-5<{REGION_S}
  UNION ALL SELECT bs[-1]['r'], 'arrival', 'minus_seconds', mass*least({REGION_S}, excess) FROM ch WHERE reason='FINAL_EGRESS_HORIZON'
  UNION ALL SELECT bs[-1]['r'], 'arrival', 'resolvable_minus', mass FROM ch WHERE reason='FINAL_EGRESS_HORIZON' AND excess<={REGION_S}
  UNION ALL SELECT ride, 'departure', 'resolvable_plus', mass FROM missed WHERE missed<={REGION_S})
SELECT ride, event, {_SUMS}, (coalesce(sum(mass) FILTER (kind='resolvable_minus'),0)-coalesce(sum(mass) FILTER (kind='protect_minus'),0))::BIGINT AS net_minus, (coalesce(sum(mass) FILTER (kind='resolvable_plus'),0)-coalesce(sum(mass) FILTER (kind='protect_plus'),0))::BIGINT AS net_plus FROM p GROUP BY ALL""")
def _(t):
    """Every departure and arrival that a move of the trust region would endanger or that would resolve a failure."""
    c = cut_lineage(chosen(t))
    record = lambda ride, event, kind, mass, held: F.when(held, F.struct(ride.alias("ride"), F.lit(event).alias("event"), F.lit(kind).alias("kind"), mass.cast("bigint").alias("mass")))
    m, first, last = F.col("mass"), F.element_at("chain", 1), F.element_at("chain", -1)
    ends = F.array(record(first["ride"], "departure", "protect_minus", m, first["dep"] - F.col("entry") - B.ACCESS_MIN_S < REGION_S),
                   record(last["ride"], "arrival", "protect_plus", m, F.col("exit") - last["arr"] - B.EGRESS_MIN_S < REGION_S))
    tight = lambda a, b: b["dep"] - a["arr"] - B.TRANSFER_MIN_S < REGION_S
    links = F.flatten(F.zip_with(F.slice("chain", 1, F.size("chain") - 1), F.slice("chain", 2, F.size("chain")), lambda a, b: F.array(
        record(a["ride"], "arrival", "protect_plus", m, tight(a, b)), record(b["ride"], "departure", "protect_minus", m, tight(a, b)))))
    held = c.where("ok").select(F.explode(F.concat(ends, links)).alias("p"))
    late = c.where("reason = 'FINAL_EGRESS_HORIZON'").select(F.explode(F.array(
        record(last["ride"], "arrival", "minus_seconds", m * F.least(F.lit(REGION_S), F.col("excess")), F.lit(True)), record(last["ride"], "arrival", "resolvable_minus", m, F.col("excess") <= REGION_S))).alias("p"))
    none = c.where("reason in ('FIRST_LEG_NO_SERVICE', 'TRANSFER_NO_DOWNSTREAM_SERVICE')").select("mass", F.col("fail_from").alias("leg_from"), F.col("fail_to").alias("leg_to"), "ready")
    r = platform_rides(t).select(F.col("from_station").alias("leg_from"), F.col("to_station").alias("leg_to"), "dep", "arr", "ride_id")
    # only a ride of the last seconds before the ready time counts
    x = J.interval_join(none.withColumns({"__id": F.monotonically_increasing_id(), "lo": F.col("ready") - REGION_S, "hi": F.col("ready") - 1}), r, ["leg_from", "leg_to"], "lo", "hi", "dep", REGION_S)
    x = x.groupBy("__id", "mass").agg(F.max(F.struct("dep", "arr", "ride_id")).alias("hit"))
    missed = x.select(record(F.col("hit.ride_id"), "departure", "resolvable_plus", m, F.lit(True)).alias("p"))
    p = held.unionByName(late).unionByName(missed).where("p is not null").select("p.*")
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0).cast("bigint"))
    return p.groupBy("ride", "event").agg(*[total(k).alias(k) for k in PRESSURE], (total("resolvable_minus") - total("protect_minus")).alias("net_minus"),
                                          (total("resolvable_plus") - total("protect_plus")).alias("net_plus"))


#: Access and transfer times as mixtures (weight, median, sigma), beam and skipped services of the replay, last second of a quantile.
ACCESS, TRANSFER = [(0.7, 14400.0, 0.8), (0.3, 43200.0, 1.1)], [(0.6, 7200.0, 0.9), (0.4, 28800.0, 1.0)]
BEAM, SKIPS, LATEST_S = 8, 2, 604800.0
#: Scale of a route's weight by its cost over the cheapest.
WEIGHT_SCALE = 0.3


def _mix_sql(x: str, kernel) -> str:
    return "(" + "+".join(f"{w!r}::DOUBLE*{lncdf_sql(x, m, s)}" for w, m, s in kernel) + ")"


def _expected_sql(mean: str, sd: str, kernel) -> str:
    nodes = "+".join(f"{w!r}::DOUBLE*{_mix_sql(f'({mean}+({z!r})::DOUBLE*{sd})', kernel)}" for z, w in zip(dist.GH_NODES, dist.GH_WEIGHTS, strict=True))
    return f"(CASE WHEN {sd}<=1e-9 THEN {_mix_sql(mean, kernel)} ELSE {nodes} END)"


def _quantiles_sql() -> str:
    """Bisection of both mixtures at the three quantiles."""
    def halves(name: str, kernel) -> str:
        return (f"{name} AS (WITH RECURSIVE b AS (SELECT q, 0.0::DOUBLE AS lo, {LATEST_S}::DOUBLE AS hi, 0 AS n FROM (VALUES (0.05::DOUBLE),(0.5),(0.95)) v(q) UNION ALL "
                f"SELECT q, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, n+1 FROM (SELECT *, {_mix_sql('mid', kernel)}<q AS below FROM (SELECT *, (lo+hi)*0.5 AS mid FROM b WHERE n<70))) "
                f"SELECT max((lo+hi)*0.5) FILTER (q=0.05) AS k05, max((lo+hi)*0.5) FILTER (q=0.5) AS k50, max((lo+hi)*0.5) FILTER (q=0.95) AS k95 FROM b WHERE n=70)")
    return halves("qa", ACCESS) + ", " + halves("qt", TRANSFER)


FAIL = f"""{RIDES}, {RIDERS}, {LROUTES}, trs AS (SELECT *, 10.0::DOUBLE+ride_id%20 AS sd FROM tr),
 gates AS (SELECT from_station AS leg_from, to_station AS leg_to, min((arr-3.0::DOUBLE*greatest(1.0,sd), ride_id)) AS g FROM trs GROUP BY ALL),
 rw AS (SELECT f, t, route_rank, e/sum(e) OVER (PARTITION BY f, t) AS weight FROM (SELECT f, t, route_rank, exp(-{WEIGHT_SCALE}::DOUBLE*(max(cost)-min(max(cost)) OVER (PARTITION BY f, t))) AS e FROM lroutes GROUP BY f, t, route_rank)),
 gl AS (SELECT l.*, g FROM lroutes l LEFT JOIN gates USING (leg_from, leg_to)),
 bad AS (SELECT p.rider_id, gl.route_rank, min((leg_no, gl.leg_from, gl.leg_to, g)) FILTER (g IS NULL OR g[1]>exit) AS b FROM riders p JOIN gl ON gl.f=p.from_station AND gl.t=p.to_station GROUP BY ALL),
 fails AS (SELECT p.rider_id AS cohort, p.mass, p.entry, p.exit, p.from_station AS f, p.to_station AS t, bad.route_rank, weight, CASE WHEN b IS NULL THEN 'FINITE_HARD_CHAIN_EXISTS' WHEN b[4] IS NULL THEN 'MISSING_SERVICE_SEGMENT' ELSE 'TIME_INCOMPATIBLE_CHAIN' END AS reason,
  b[1] AS leg_no, b[2] AS leg_from, b[3] AS leg_to, b[4][2] AS closest, b[4][1]-exit AS excess FROM bad JOIN riders p USING (rider_id) JOIN rw ON rw.f=p.from_station AND rw.t=p.to_station AND rw.route_rank=bad.route_rank)"""


def rides_with_sd(t):
    return platform_rides(t).withColumn("sd", F.lit(10.0) + F.col("ride_id") % 20)


@staged
def failures(t):
    cost = line_routes(t).groupBy(*B.OD, "route_rank").agg(F.max("cost").alias("cost")).withColumn("od", F.struct(*B.OD))
    weights = B.structural_weights(cost, "od", "cost", WEIGHT_SCALE, "weight").select(*B.OD, "route_rank", "weight")
    return RP.route_failures(cohorts(t), line_routes(t), rides_with_sd(t)).join(weights, [*B.OD, "route_rank"])


@query("B44_exit_horizon_audit", f"""
WITH RECURSIVE {CHAIN.replace(RIDES + ", " + RIDERS + ", " + LROUTES, FAIL)}, st AS (SELECT cohort, route_rank, reason AS stored FROM ev)
SELECT fails.cohort, fails.route_rank, fails.reason, stored, leg_no, leg_from, leg_to, closest, round(excess,3) AS excess, round(weight,6) AS weight FROM fails JOIN st ON st.cohort=fails.cohort AND st.route_rank=fails.route_rank""")
def _(t):
    """Each candidate route's hard failure, the ride closest to the horizon, and the reason that the chain search had given."""
    stored = evaluated(t).select("cohort", "route_rank", F.col("reason").alias("stored"))
    return failures(t).join(stored, ["cohort", "route_rank"]).select("cohort", "route_rank", "reason", "stored", "leg_no", "leg_from", "leg_to", "closest", F.round("excess", 3).alias("excess"),
                                                                      F.round("weight", 6).alias("weight"))


def _replay_sql() -> str:
    """The beam unrolled over the legs before the failing one, and the envelope at it."""
    parts = [f"""n AS (SELECT *, row_number() OVER (PARTITION BY from_station, to_station ORDER BY dep, ride_id) AS pos FROM trs),
 opts AS (SELECT i.from_station, i.to_station, i.ride_id, i.arr, i.sd, k AS n_skip, u.dep AS u_dep, u.sd AS u_sd, l.dep AS l_dep, l.sd AS l_sd, least({SKIPS + 1}, i.pos) AS options FROM (SELECT *, unnest(range(0, {SKIPS + 1})) AS k FROM n) i
  JOIN n u ON u.from_station=i.from_station AND u.to_station=i.to_station AND u.pos=i.pos-k LEFT JOIN n l ON l.from_station=i.from_station AND l.to_station=i.to_station AND l.pos=i.pos-k-1),
 s1 AS (SELECT cohort, route_rank, f, t, entry, exit, leg_no AS stop, entry::DOUBLE AS ready, 0.0::DOUBLE AS ready_sd, 0.0::DOUBLE AS logp FROM fails WHERE leg_no IS NOT NULL)""", _quantiles_sql()]
    for leg in range(1, 4):
        kernel = ACCESS if leg == 1 else TRANSFER
        parts.append(f"""x{leg} AS (SELECT s.* EXCLUDE (ready, ready_sd, logp), s.logp AS before, o.*, u_dep-ready AS um, sqrt(u_sd*u_sd+ready_sd*ready_sd) AS us, l_dep-ready AS lm, sqrt(l_sd*l_sd+ready_sd*ready_sd) AS ls FROM s{leg} s JOIN lroutes r ON r.f=s.f AND r.t=s.t AND r.route_rank=s.route_rank AND r.leg_no={leg}
   JOIN opts o ON o.from_station=r.leg_from AND o.to_station=r.leg_to AND u_dep BETWEEN ready-{RP.EARLY_S} AND exit+180 AND o.arr-3.0::DOUBLE*greatest(1.0,o.sd)<=exit WHERE stop>{leg}),
 y{leg} AS (SELECT *, {_expected_sql('um', 'us', kernel)}-coalesce({_expected_sql('lm', 'ls', kernel)},0) AS prob FROM x{leg}), z{leg} AS (SELECT *, round(before+ln(prob)-ln(options),9) AS logp FROM y{leg} WHERE prob>{RP.LEAST_PROBABILITY}),
 s{leg + 1} AS (SELECT cohort, route_rank, f, t, entry, exit, stop, arr::DOUBLE AS ready, sd AS ready_sd, logp FROM z{leg} QUALIFY row_number() OVER (PARTITION BY cohort, route_rank ORDER BY logp DESC, arr, ride_id, n_skip)<={BEAM})""")
    ends = " UNION ALL ".join(f"SELECT cohort, route_rank, count(*) AS n_states, min(ready-entry)+max(k05) AS q05, sum(exp(logp-top)*(ready-entry))/sum(exp(logp-top))+max(k50) AS q50, max(ready-entry)+max(k95) AS q95 "
                              f"FROM (SELECT *, max(logp) OVER (PARTITION BY cohort, route_rank) AS top FROM s{leg} WHERE stop={leg}), {'qa' if leg == 1 else 'qt'} GROUP BY ALL" for leg in range(1, 5))
    return ",\n ".join(parts) + f",\n env AS ({ends}), rp AS (SELECT fails.*, n_states, q05, q50, q95 FROM fails LEFT JOIN env USING (cohort, route_rank) WHERE leg_no IS NOT NULL)"


REPLAY = f"{FAIL}, {_replay_sql()}"


def replayed(t, reason: str):
    """The replay of the routes that failed for a reason."""
    f = failures(t).where(F.col("reason") == reason)
    return RP.replay(f, line_routes(t), RP.boarding_options(rides_with_sd(t), SKIPS, MONTH_S), ACCESS, TRANSFER, BEAM, LATEST_S)


@query("B43_ready_envelope", f"""
WITH RECURSIVE {REPLAY} SELECT cohort, route_rank, leg_no, leg_from, leg_to, CASE WHEN n_states IS NULL THEN 'TIME_INCOMPATIBLE_CHAIN_BEFORE_SEGMENT' ELSE reason END AS reason, n_states, round(q05,3) AS q05, round(q50,3) AS q50, round(q95,3) AS q95
FROM rp WHERE reason='MISSING_SERVICE_SEGMENT'""")
def _(t):
    """When the travellers of a route were ready for the first leg that nothing serves, in seconds after their entry."""
    x = replayed(t, "MISSING_SERVICE_SEGMENT").withColumn("reason", F.when(F.col("n_states").isNull(), "TIME_INCOMPATIBLE_CHAIN_BEFORE_SEGMENT").otherwise(F.col("reason")))
    return x.select("cohort", "route_rank", "leg_no", "leg_from", "leg_to", "reason", "n_states", *[F.round(q, 3).alias(q) for q in RP.QUANTILES])


def _support_sql(reason: str) -> str:
    """Services of the other track between the stations of the failing legs, and the mass they could take up (millionths, whole)."""
    masses = ", ".join(f"coalesce(sum(m) FILTER (arr<=exit AND dep>={q}),0)::BIGINT AS {q}_mass" for q in RP.QUANTILES)
    return f"""rec AS (SELECT leg_from, leg_to, f, t, round(mass*weight*1000000)::BIGINT AS m, exit, round(entry+q05,3) AS q05, round(entry+q50,3) AS q50, round(entry+q95,3) AS q95 FROM rp WHERE reason='{reason}' AND n_states IS NOT NULL),
 segs AS (SELECT DISTINCT leg_from, leg_to FROM rec), svc AS (SELECT leg_from, leg_to, ride_id, dep, arr FROM segs JOIN tr ON tr.from_station//10=leg_from//10 AND tr.to_station//10=leg_to//10 AND tr.from_station<>leg_from),
 sup AS (SELECT svc.leg_from, svc.leg_to, svc.ride_id, coalesce(sum(m) FILTER (arr<=exit),0)::BIGINT AS exit_mass, {masses}, count(*) FILTER (arr<=exit AND dep>=q50) AS q50_cohorts FROM svc JOIN rec ON rec.leg_from=svc.leg_from AND rec.leg_to=svc.leg_to GROUP BY ALL)"""


def _records(t, reason: str):
    x = replayed(t, reason).where("n_states is not null")
    return x.select("leg_from", "leg_to", *B.OD, F.round(F.col("mass") * F.col("weight") * 1000000).cast("bigint").alias("mass"), "exit", *[F.round(F.col("entry") + F.col(q), 3).alias(q) for q in RP.QUANTILES])


def _support(t, records):
    segs = records.select("leg_from", "leg_to").distinct().withColumns({"a": F.floor(F.col("leg_from") / 10), "b": F.floor(F.col("leg_to") / 10)})
    r = platform_rides(t).select(F.col("from_station").alias("own"), F.floor(F.col("from_station") / 10).alias("a"), F.floor(F.col("to_station") / 10).alias("b"), "ride_id", "dep", "arr")
    services = cut_lineage(segs.join(r, ["a", "b"]).where("own <> leg_from").select("leg_from", "leg_to", "ride_id", "dep", "arr"))
    return RP.service_support(services, records, RP.LEG, MONTH_S)


@query("B45_root_support", f"WITH RECURSIVE {REPLAY}, {_support_sql('MISSING_SERVICE_SEGMENT')} SELECT leg_from, leg_to, ride_id, exit_mass, q05_mass, q50_mass, q95_mass, q50_cohorts FROM sup")
def _(t):
    """Mass stuck at unserved legs that each service of another track could take up."""
    return _support(t, cut_lineage(_records(t, "MISSING_SERVICE_SEGMENT"))).select("leg_from", "leg_to", "ride_id", "exit_mass", "q05_mass", "q50_mass", "q95_mass", "q50_cohorts")


@query("B51_exit_horizon_qualification", f"""
WITH RECURSIVE {REPLAY}, {_support_sql('TIME_INCOMPATIBLE_CHAIN')}, best AS (SELECT *, count(*) OVER (PARTITION BY leg_from, leg_to) AS services FROM sup QUALIFY row_number() OVER (PARTITION BY leg_from, leg_to ORDER BY q50_mass DESC, q95_mass DESC, exit_mass DESC, ride_id)=1)
SELECT s.leg_from, s.leg_to, pressure, cohorts, od_pairs, coalesce(services,0) AS services, ride_id, round(coalesce(q50_mass/pressure,0),6) AS q50_share, round(coalesce(q95_mass/pressure,0),6) AS q95_share, coalesce(q50_mass/pressure,0)>=0.5 AND od_pairs>=2 AS trial
FROM (SELECT leg_from, leg_to, sum(m)::BIGINT AS pressure, count(*) AS cohorts, count(DISTINCT (f,t)) AS od_pairs FROM rec GROUP BY ALL) s LEFT JOIN best ON best.leg_from=s.leg_from AND best.leg_to=s.leg_to""")
def _(t):
    """Legs whose every ride is past the exit horizon, and the best service of another track for each."""
    records = cut_lineage(_records(t, "TIME_INCOMPATIBLE_CHAIN"))
    q = RP.qualify_segments(records, cut_lineage(_support(t, records)), RP.LEG, 0.5, 2)
    return q.select("leg_from", "leg_to", "pressure", "cohorts", "od_pairs", "services", "ride_id", F.round("q50_share", 6).alias("q50_share"), F.round("q95_share", 6).alias("q95_share"), "trial")
