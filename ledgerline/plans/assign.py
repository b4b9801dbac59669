"""Probabilistic assignment queries.

Orders are cohorts, order lines are rides. Every pair of stations has a direct route
and, when it is long enough, one with a change half way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.functions import clocks, dist
from ledgerline.operators import aggregates as A
from ledgerline.operators import assign as B
from ledgerline.operators import joins as J
from ledgerline.operators import quantiles as Q
from ledgerline.operators import topk as K
from ledgerline.plans.scalars import gh_sql, lid_sql, lncdf_sql, phi_sql
from ledgerline.plans.views import RIDERS, RIDES, riders, rides
from ledgerline.registry import query, staged
from ledgerline.session import cut_lineage

MONTH_S = 30 * clocks.DAY_S
KERNELS = {"access": (14400.0, 1.2), "transfer": (14400.0, 1.2), "egress": (14400.0, 1.2)}

ROUTES = """od0 AS (SELECT DISTINCT from_station AS f, to_station AS t, (to_station-from_station+25)%25 AS d FROM riders),
 routes AS (SELECT f, t, 1 AS route_rank, 1 AS legs, 1 AS leg_no, f AS leg_from, t AS leg_to, d*60.0::DOUBLE AS cost FROM od0 UNION ALL SELECT f,t,2,2,1,f,(f+d//2)%25,d*60.0::DOUBLE+90 FROM od0 WHERE d>=2 UNION ALL SELECT f,t,2,2,2,(f+d//2)%25,t,d*60.0::DOUBLE+90 FROM od0 WHERE d>=2)"""


def cohorts(t):
    return riders(t).withColumnRenamed("rider_id", "cohort")


def routes(t):
    o = riders(t).select("from_station", "to_station").distinct().withColumn("d", F.pmod(F.col("to_station") - F.col("from_station"), F.lit(25)))
    mid = F.pmod(F.col("from_station") + F.floor(F.col("d") / 2), F.lit(25)).cast("int")
    leg = lambda rank, legs, no, a, b, extra: F.struct(F.lit(rank).alias("route_rank"), F.lit(legs).alias("legs"), F.lit(no).alias("leg_no"), a.cast("int").alias("leg_from"), b.cast("int").alias("leg_to"),
                                                       (F.col("d") * 60.0 + extra).alias("cost"))
    f, to = F.col("from_station"), F.col("to_station")
    direct, change = [leg(1, 1, 1, f, to, 0.0)], [leg(2, 2, 1, f, mid, 90.0), leg(2, 2, 2, mid, to, 90.0)]
    return o.select("from_station", "to_station", F.explode(F.when(F.col("d") >= 2, F.array(*direct, *change)).otherwise(F.array(*direct))).alias("r")).select("from_station", "to_station", "r.*")


#: Routes of 1 to 4 legs, each on one of three tracks, the last of which no ride serves. Platforms are station and track.
LROUTES = """od1 AS (SELECT DISTINCT from_station AS f, to_station AS t, (to_station-from_station+25)%25 AS d FROM riders),
 hops AS (SELECT f, t, d, k, i, (f+d*(i-1)//k)%25 AS a, (f+d*i//k)%25 AS b FROM od1, range(1,5) AS ks(k), range(1,5) AS steps(i) WHERE k<=greatest(d,1) AND i<=k),
 lroutes AS (SELECT f, t, k::INT AS route_rank, k::INT AS legs, i::INT AS leg_no, ((a*5+k*2+i)%3)::INT AS track, (a*10+(a*5+k*2+i)%3)::INT AS leg_from, (b*10+(a*5+k*2+i)%3)::INT AS leg_to, d*1.0::DOUBLE+k AS cost FROM hops),
 tr AS (SELECT ride_id, from_station*10+line%2 AS from_station, to_station*10+line%2 AS to_station, dep, arr FROM rides)"""


def line_routes(t):
    o = riders(t).select("from_station", "to_station").distinct().withColumn("d", F.pmod(F.col("to_station") - F.col("from_station"), F.lit(25)))
    x = o.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), F.greatest("d", F.lit(1))))).alias("k")).select("*", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i"))
    stop = lambda i: F.pmod(F.col("from_station") + F.floor(F.col("d") * i / F.col("k")), F.lit(25)).cast("int")
    x = x.withColumns({"a": stop(F.col("i") - 1), "b": stop(F.col("i"))}).withColumn("track", ((F.col("a") * 5 + F.col("k") * 2 + F.col("i")) % 3).cast("int"))
    return x.select("from_station", "to_station", F.col("k").alias("route_rank"), F.col("k").alias("legs"), F.col("i").alias("leg_no"), "track", (F.col("a") * 10 + F.col("track")).alias("leg_from"),
                    (F.col("b") * 10 + F.col("track")).alias("leg_to"), (F.col("d") * 1.0 + F.col("k")).alias("cost"))


def platform_rides(t):
    """All rides, their ends as platforms."""
    return rides(t).withColumns({c: F.col(c) * 10 + F.col("line") % 2 for c in ("from_station", "to_station")})


IDX = """ix AS (SELECT from_station, to_station, dep, min(best) AS best FROM (SELECT from_station, to_station, dep, min((arr, dep, ride_id)) OVER (PARTITION BY from_station, to_station ORDER BY dep, ride_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM tr) GROUP BY ALL)"""
_KEPT = "rider_id, mass, entry, exit, f, t, route_rank, legs"


def _chain_sql(travellers: str, prefix: str = "", kept: str = _KEPT, entry: str = "entry", exit_: str = "exit") -> str:
    """Earliest chains of up to four legs: ``bs`` lists (arr, dep, ride) of the legs ridden."""
    p, parts, ends = prefix, [], []
    parts.append(f"{p}g1 AS (SELECT {kept}, leg_from, leg_to, {entry}+15 AS ready, []::STRUCT(a BIGINT, d BIGINT, r BIGINT)[] AS bs FROM {travellers} p JOIN lroutes r ON r.f=p.from_station AND r.t=p.to_station AND r.leg_no=1)")
    for k in range(1, 5):
        parts.append(f"{p}h{k} AS (SELECT g.*, ix.best AS b FROM {p}g{k} g ASOF LEFT JOIN ix ON ix.from_station=g.leg_from AND ix.to_station=g.leg_to AND ix.dep>=g.ready)")
        if k < 4:
            rest = ", ".join(f"h.{c.strip()}" for c in kept.split(","))
            parts.append(f"{p}g{k + 1} AS (SELECT {rest}, r.leg_from, r.leg_to, b[1]+5 AS ready, list_append(bs, b) AS bs FROM {p}h{k} h JOIN lroutes r ON r.f=h.f AND r.t=h.t AND r.route_rank=h.route_rank AND r.leg_no={k + 1} WHERE b IS NOT NULL AND h.legs>{k})")
        none = "FIRST_LEG_NO_SERVICE" if k == 1 else "TRANSFER_NO_DOWNSTREAM_SERVICE"
        ends.append(f"SELECT * EXCLUDE (b, bs), rider_id AS cohort, CASE WHEN b IS NULL THEN bs ELSE list_append(bs, b) END AS bs, CASE WHEN b IS NULL THEN '{none}' WHEN b[1]>{exit_}-15 THEN 'FINAL_EGRESS_HORIZON' ELSE 'FEASIBLE_COMPLETE_CHAIN' END AS reason, "
                    f"CASE WHEN b IS NULL THEN {k - 2} ELSE legs END AS progress, CASE WHEN b[1]>{exit_}-15 THEN b[1]-({exit_}-15) END AS excess FROM {p}h{k} WHERE legs={k} OR b IS NULL")
    return ",\n ".join(parts) + f",\n {p}ev AS ({' UNION ALL '.join(ends)})"


CHAIN = f"""{RIDES}, {RIDERS}, {LROUTES}, {IDX},
 {_chain_sql("riders")},
 ch AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY (reason<>'FEASIBLE_COMPLETE_CHAIN'), CASE WHEN reason='FEASIBLE_COMPLETE_CHAIN' THEN route_rank ELSE 0 END, -progress,
   CASE reason WHEN 'FINAL_EGRESS_HORIZON' THEN -3 WHEN 'TRANSFER_NO_DOWNSTREAM_SERVICE' THEN -2 WHEN 'FIRST_LEG_NO_SERVICE' THEN -1 ELSE 0 END, coalesce(excess,0), route_rank)=1)"""
SERVICES = "array_to_string(list_transform(bs, lambda s: s['r']::VARCHAR), '>')"


@staged
def evaluated(t):
    return B.earliest_chains(cohorts(t), line_routes(t), platform_rides(t), clocks.DAY_S)


def chosen(t):
    return B.choose_chain(evaluated(t), "cohort")


@query("B01_earliest_feasible_chain", f"""WITH {CHAIN} SELECT cohort, route_rank, reason='FEASIBLE_COMPLETE_CHAIN' AS ok, progress, excess, CASE WHEN reason='FEASIBLE_COMPLETE_CHAIN' THEN {SERVICES} ELSE '' END AS rides FROM ev""")
def _(t):
    label = F.array_join(F.transform("chain", lambda s: s["ride"].cast("string")), ">")
    return evaluated(t).select("cohort", "route_rank", "ok", "progress", "excess", F.when(F.col("ok"), label).otherwise("").alias("rides"))


@query("B02_failure_choice", f"WITH {CHAIN} SELECT cohort, route_rank, reason, progress, excess FROM ch")
def _(t):
    return chosen(t).select("cohort", "route_rank", "reason", "progress", "excess")


@query("B03_pressure_records", f"""
WITH {CHAIN}, fl AS (SELECT * FROM ch WHERE reason LIKE '%NO%SERVICE'), pv AS (SELECT fl.cohort, d.dep AS prev_dep FROM fl ASOF LEFT JOIN (SELECT DISTINCT from_station, to_station, dep FROM tr) d ON d.from_station=fl.leg_from AND d.to_station=fl.leg_to AND d.dep<fl.ready)
SELECT reason, leg_from, leg_to, ready//300 AS time_bin, sum(mass)::BIGINT AS mass, max(ready-prev_dep) AS missed_by FROM fl JOIN pv USING (cohort) GROUP BY ALL""")
def _(t):
    f = chosen(t).where("reason in ('FIRST_LEG_NO_SERVICE', 'TRANSFER_NO_DOWNSTREAM_SERVICE')").select("cohort", "mass", "reason", F.col("fail_from").alias("leg_from"), F.col("fail_to").alias("leg_to"), "ready")
    r = platform_rides(t).withColumnsRenamed({"from_station": "leg_from", "to_station": "leg_to"})
    x = J.asof(f, r, ["leg_from", "leg_to"], "ready", "dep", [], MONTH_S, "hit", strict=True)
    return x.groupBy("reason", "leg_from", "leg_to", F.floor(F.col("ready") / 300).alias("time_bin")).agg(F.sum("mass").alias("mass"), F.max(F.col("ready") - F.col("hit.dep")).alias("missed_by"))


@query("B04_assignment_mass", f"""
WITH {CHAIN}, u AS (SELECT unnest(bs)['r'] AS ride, mass FROM ch WHERE reason='FEASIBLE_COMPLETE_CHAIN') SELECT ride, sum(mass)::BIGINT AS mass, count(*) AS cohorts FROM u GROUP BY 1""")
def _(t):
    return B.chain_services(chosen(t)).groupBy("ride").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("cohorts"))


@query("A47_missing_service_pressure", f"WITH {CHAIN} SELECT leg_from, leg_to, sum(mass)::BIGINT AS mass, count(*) AS candidates FROM ev WHERE reason LIKE '%NO%SERVICE' GROUP BY ALL")
def _(t):
    f = evaluated(t).where("reason in ('FIRST_LEG_NO_SERVICE', 'TRANSFER_NO_DOWNSTREAM_SERVICE')")
    return f.groupBy(F.col("fail_from").alias("leg_from"), F.col("fail_to").alias("leg_to")).agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("candidates"))


@query("A50_support_scan", f"""
WITH {CHAIN}, e AS (SELECT legs-1 AS transfers, sum(mass)::BIGINT AS mass, sum(CASE WHEN reason='FEASIBLE_COMPLETE_CHAIN' THEN mass ELSE 0 END)::BIGINT AS finite_mass, sum(CASE WHEN reason LIKE '%NO%SERVICE' THEN mass ELSE 0 END)::BIGINT AS missing_mass, sum(CASE WHEN reason='FINAL_EGRESS_HORIZON' THEN mass ELSE 0 END)::BIGINT AS late_mass FROM ev GROUP BY 1)
SELECT *, (SELECT sum(mass)::BIGINT FROM ch WHERE reason='FEASIBLE_COMPLETE_CHAIN') AS any_route_mass FROM e""")
def _(t):
    e = cut_lineage(evaluated(t))
    part = lambda c: F.sum(F.when(c, F.col("mass")).otherwise(0))
    any_ok = e.groupBy("cohort").agg(F.bool_or("ok").alias("ok"), F.max("mass").alias("mass")).agg(F.sum(F.when(F.col("ok"), F.col("mass")).otherwise(0)))
    return e.groupBy((F.col("legs") - 1).alias("transfers")).agg(F.sum("mass").alias("mass"), part(F.col("ok")).alias("finite_mass"), part(F.col("reason").like("%NO%SERVICE")).alias("missing_mass"),
                                                                 part(F.col("reason") == "FINAL_EGRESS_HORIZON").alias("late_mass")).withColumn("any_route_mass", any_ok.scalar())


POST = f"""{RIDES}, {RIDERS}, {ROUTES}, rd AS (SELECT *, 10.0::DOUBLE + ride_id%20 AS sd FROM rides),
 s1 AS (SELECT p.rider_id, p.mass, p.entry, p.exit, r.route_rank, r.legs, r.cost, r.f, r.t, ride_id AS r1, arr AS last_t, sd AS last_sd, (dep-entry)::DOUBLE AS a_c, sd AS a_sd FROM riders p JOIN routes r ON r.f=p.from_station AND r.t=p.to_station AND r.leg_no=1 JOIN rd ON rd.from_station=r.leg_from AND rd.to_station=r.leg_to AND dep BETWEEN entry-900 AND exit+900),
 k1 AS (SELECT *, {lid_sql('a_c', 'a_sd', 14400.0, 1.2)} AS score FROM s1), b1 AS (SELECT * FROM k1 WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rider_id, route_rank ORDER BY score DESC, r1)<=8),
 s2 AS (SELECT b1.* EXCLUDE (last_t, last_sd), ride_id AS r2, rd.arr AS n_t, rd.sd AS n_sd, (dep-last_t)::DOUBLE AS t_c, sqrt(last_sd*last_sd+rd.sd*rd.sd) AS t_sd FROM b1 JOIN routes r ON r.f=b1.f AND r.t=b1.t AND r.route_rank=b1.route_rank AND r.leg_no=2 JOIN rd ON rd.from_station=r.leg_from AND rd.to_station=r.leg_to AND dep BETWEEN last_t-900 AND exit+900 WHERE b1.legs=2),
 k2 AS (SELECT * EXCLUDE (score), score + {lid_sql('t_c', 't_sd', 14400.0, 1.2)} AS score FROM s2), b2 AS (SELECT * FROM k2 WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rider_id, route_rank ORDER BY score DESC, r1, r2)<=8),
 fin AS (SELECT rider_id, mass, entry, exit, route_rank, legs, r1, NULL::BIGINT AS r2, a_c, a_sd, NULL::DOUBLE AS t_c, NULL::DOUBLE AS t_sd, (exit-last_t)::DOUBLE AS e_c, last_sd AS e_sd, score, 0.0::DOUBLE AS extra FROM b1 WHERE legs=1 UNION ALL SELECT rider_id, mass, entry, exit, route_rank, legs, r1, r2, a_c, a_sd, t_c, t_sd, (exit-n_t)::DOUBLE, n_sd, score, 90.0 FROM b2),
 sc AS (SELECT * EXCLUDE (score), score + {lid_sql('e_c', 'e_sd', 14400.0, 1.2)} - extra/300.0::DOUBLE AS score FROM fin), ok AS (SELECT * FROM sc WHERE score IS NOT NULL),
 post AS (SELECT *, exp(score - max(score) OVER (PARTITION BY rider_id)) AS e0 FROM ok), po AS (SELECT *, e0/sum(e0) OVER (PARTITION BY rider_id) AS p FROM post)"""


def scoring(t):
    r = rides(t).withColumn("sd", F.lit(10.0) + F.col("ride_id") % 20)
    return cohorts(t), routes(t), r, KERNELS, 8, MONTH_S


def post(t):
    """One row per traveller with its chains, if it has any. No table of chains is written, so a query should read it once."""
    return B.posteriors(*scoring(t)).where(F.size("chains") > 0)


LABEL = "r1::VARCHAR||coalesce('>'||r2::VARCHAR,'')"


@query("B05_scored_beam", f"WITH {POST} SELECT rider_id AS cohort, route_rank, {LABEL} AS chain, round(score,4) AS score FROM ok")
def _(t):
    return B.scored_chains(*scoring(t)).select("cohort", "route_rank", B.chain_label().alias("chain"), F.round("score", 4).alias("score"))


@query("B06_posterior", f"""
WITH {POST}, rp AS (SELECT rider_id, route_rank, sum(p) AS rp FROM po GROUP BY 1,2), e AS (SELECT rider_id, -sum(rp*ln(greatest(rp,1e-300::DOUBLE))) AS entropy, arg_min(route_rank,(-rp,route_rank)) AS top_route, max(rp) AS top_route_p FROM rp GROUP BY 1)
SELECT rider_id AS cohort, round(entropy,4) AS entropy, top_route, round(top_route_p,4) AS top_route_p, round(top,4) AS top_chain_p FROM e JOIN (SELECT rider_id, max(p) AS top FROM po GROUP BY 1) USING (rider_id)""")
def _(t):
    s = B.route_summary(post(t), "cohort")
    return s.select("cohort", *[F.round(c, 4).alias(c) for c in ("entropy", "top_route_p", "top_chain_p")], "top_route")


@query("B07_station_only_proxy", f"WITH {RIDERS}, x AS (SELECT rider_id, mass, (exit-entry)::DOUBLE AS d FROM riders) SELECT rider_id AS cohort, round({lid_sql('d', '1.0::DOUBLE', 300.0, 1.2)},4) AS score FROM x")
def _(t):
    return cohorts(t).select("cohort", F.round(B.station_only_score(F.col("entry"), F.col("exit")), 4).alias("score"))


@query("B08_skip_alternatives", f"""
WITH {RIDES}, n AS (SELECT *, row_number() OVER (PARTITION BY from_station, to_station ORDER BY dep, ride_id) AS pos FROM rides), x AS (SELECT *, unnest(range(0, least(2,pos-1)+1)) AS n_skip, least(2,pos-1)+1 AS k FROM n)
SELECT x.ride_id, n_skip::INT AS n_skip, y.dep AS first_dep, round(1.0::DOUBLE/k,6) AS weight FROM x JOIN n y ON y.from_station=x.from_station AND y.to_station=x.to_station AND y.pos=x.pos-n_skip""")
def _(t):
    r = rides(t).select("ride_id", "from_station", "to_station", "dep")
    s = B.skip_alternatives(r.select("ride_id", "from_station", "to_station"), r, ["from_station", "to_station"], 2, MONTH_S)
    return s.select("ride_id", "n_skip", "first_dep", F.round("weight", 6).alias("weight"))


@query("B09_structural_weight", """
WITH c AS (SELECT l_orderkey, l_suppkey, min(l_tax*100) AS cost FROM lineitem GROUP BY ALL), e AS (SELECT *, exp(-0.3::DOUBLE*(cost-min(cost) OVER (PARTITION BY l_orderkey))) AS e FROM c)
SELECT l_orderkey, l_suppkey, round(e/sum(e) OVER (PARTITION BY l_orderkey),6) AS weight FROM e""")
def _(t):
    c = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min(F.col("l_tax") * 100).alias("cost"))
    return B.structural_weights(c, "l_orderkey", "cost", 0.3, "weight").select("l_orderkey", "l_suppkey", F.round("weight", 6).alias("weight"))


LIN = f"{POST}, lin AS (SELECT rider_id AS cohort, mass, route_rank, {LABEL} AS root_chain, legs-1 AS transfers, p, mass*p AS lineage_mass, NULL AS unresolved_reason FROM po UNION ALL SELECT rider_id, mass, NULL, '', 0, 1.0, mass, 'NO_COMPATIBLE_SERVICE' FROM riders WHERE rider_id NOT IN (SELECT rider_id FROM po))"


def lineage(t):
    return B.lineage(B.posteriors(*scoring(t)))


@query("B10_lineage_edges", f"WITH {LIN} SELECT cohort, mass, route_rank, root_chain, transfers, round(p,4) AS p, round(lineage_mass,4) AS lineage_mass, unresolved_reason FROM lin")
def _(t):
    return lineage(t).withColumns({"p": F.round("p", 4), "lineage_mass": F.round("lineage_mass", 4)})


@query("B11_lineage_aggregates", f"""
WITH {LIN} SELECT transfers, unresolved_reason IS NULL AS resolved, count(DISTINCT cohort) AS cohorts, round(sum(lineage_mass),4) AS mass FROM lin GROUP BY 1,2""")
def _(t):
    return lineage(t).groupBy("transfers", F.col("unresolved_reason").isNull().alias("resolved")).agg(F.count_distinct("cohort").alias("cohorts"), F.round(F.sum("lineage_mass"), 4).alias("mass"))


@query("B12_event_evidence", f"""
WITH {POST}, u AS (SELECT r1 AS root, mass*p AS w, true AS first, legs=1 AS last FROM po UNION ALL SELECT r2, mass*p, false, true FROM po WHERE r2 IS NOT NULL)
SELECT root, round(sum(w),4) AS boarding, round(sum(CASE WHEN first THEN w ELSE 0 END),4) AS entry_boarding, round(sum(CASE WHEN last THEN w ELSE 0 END),4) AS exit_alighting, round(sum(CASE WHEN NOT first THEN w ELSE 0 END),4) AS transfer_departure, round(sum(CASE WHEN NOT last THEN w ELSE 0 END),4) AS transfer_arrival FROM u GROUP BY 1""")
def _(t):
    x = B.chains_of(post(t), "cohort").select("mass", "p", F.size("steps").alias("n"), F.posexplode("steps").alias("i", "s")).withColumns({"w": F.col("mass") * F.col("p"), "root": F.col("s.ride")})
    first, last = F.col("i") == 0, F.col("i") == F.col("n") - 1
    part = lambda c, n: F.round(F.sum(F.when(c, F.col("w")).otherwise(0.0)), 4).alias(n)
    return x.groupBy("root").agg(F.round(F.sum("w"), 4).alias("boarding"), part(first, "entry_boarding"), part(last, "exit_alighting"), part(~first, "transfer_departure"), part(~last, "transfer_arrival"))


FAC = f"""{POST}, fac AS (SELECT rider_id AS cohort, 'access' AS factor, NULL::BIGINT AS lower_root, r1 AS upper_root, a_c AS centre, a_sd AS sd, mass*p AS w FROM po UNION ALL SELECT rider_id, 'transfer', r1, r2, t_c, t_sd, mass*p FROM po WHERE r2 IS NOT NULL UNION ALL SELECT rider_id, 'egress', coalesce(r2,r1), NULL, e_c, e_sd, mass*p FROM po)"""


def factors(t):
    return B.factors(post(t))


@query("B13_factor_histograms", f"WITH {FAC} SELECT factor, lower_root, upper_root, count(*) AS n, round(sum(w),4) AS mass FROM fac GROUP BY ALL")
def _(t):
    return B.factor_pairs(scoring(t)).select(B.factor_name().alias("factor"), "lower_root", "upper_root", "n", F.round("mass", 4).alias("mass"))


STATS = f"{FAC}, st AS (SELECT factor, sum(w) AS w, sum(w*ln(centre)) AS sum_log, sum(w*ln(centre)*ln(centre)) AS sum_log2 FROM fac WHERE centre>0 AND w>0 GROUP BY 1)"


def kernel_stats(t):
    return B.log_sums(scoring(t)).withColumn("factor", B.factor_name())


@query("B14_kernel_statistics", f"WITH {STATS} SELECT factor, round(w,4) AS w, round(sum_log,3) AS sum_log, round(sum_log2,3) AS sum_log2 FROM st")
def _(t):
    return kernel_stats(t).select("factor", F.round("w", 4).alias("w"), F.round("sum_log", 3).alias("sum_log"), F.round("sum_log2", 3).alias("sum_log2"))


@query("B15_kernel_update", f"""
WITH {STATS}, f AS (SELECT factor, exp(sum_log/w) AS fm, least(2.5,greatest(0.12,sqrt(greatest(1e-8,sum_log2/w-(sum_log/w)*(sum_log/w))))) AS fs FROM st)
SELECT factor, round(exp(0.65::DOUBLE*ln(14400.0::DOUBLE)+0.35::DOUBLE*ln(fm)),3) AS median, round(exp(0.65::DOUBLE*ln(1.2::DOUBLE)+0.35::DOUBLE*ln(fs)),4) AS sigma FROM f""")
def _(t):
    u = B.kernel_update(kernel_stats(t), F.lit(14400.0), F.lit(1.2))
    return u.select("factor", F.round("median", 3).alias("median"), F.round("sigma", 4).alias("sigma"))


MEDIANS, SIGMAS = [3600.0, 7200.0, 14400.0, 28800.0], [0.4, 0.8, 1.6]
OBS = """obs AS (SELECT l_linenumber AS ctx, (l_suppkey%40)*600.0::DOUBLE AS lower, (l_suppkey%40)*600.0::DOUBLE+1800+(l_linenumber*300) AS upper, l_quantity AS w FROM lineitem)"""


def observations(t):
    lo = (F.col("l_suppkey") % 40) * 600.0
    return t.lineitem.select(F.col("l_linenumber").alias("ctx"), lo.alias("lower"), (lo + 1800 + F.col("l_linenumber") * 300).alias("upper"), F.col("l_quantity").alias("w"))


def grid_sql() -> str:
    parts = []
    for m in MEDIANS:
        for s in SIGMAS:
            lp = f"ln(greatest(1e-14::DOUBLE, {lncdf_sql('upper', m, s)} - CASE WHEN lower>0 THEN {lncdf_sql('lower', m, s)} ELSE 0.0::DOUBLE END))"
            parts.append(f"SELECT ctx, {m}::DOUBLE AS median, {s}::DOUBLE AS sigma, sum(-w*{lp}) AS loss FROM cells GROUP BY 1")
    return " UNION ALL ".join(parts)


@query("B16_censored_grid_fit", f"""
WITH {OBS}, cells AS (SELECT ctx, lower, upper, sum(w) AS w FROM obs GROUP BY ALL), g AS ({grid_sql()})
SELECT ctx, arg_min(median,(round(loss,6),median,sigma)) AS median, arg_min(sigma,(round(loss,6),median,sigma)) AS sigma, round(min(loss),2) AS loss FROM g GROUP BY 1""")
def _(t):
    return B.grid_fit(observations(t), ["ctx"], MEDIANS, SIGMAS).select("ctx", "median", "sigma", F.round("loss", 2).alias("loss"))


@query("B17_context_fallback", """
WITH s AS (SELECT l_suppkey AS station, l_linenumber AS hr, count(*) AS w, exp(avg(ln(l_extendedprice))) AS m FROM lineitem GROUP BY ALL), st AS (SELECT l_suppkey AS station, count(*) AS w, exp(avg(ln(l_extendedprice))) AS m FROM lineitem GROUP BY 1), g AS (SELECT count(*) AS w, exp(avg(ln(l_extendedprice))) AS m FROM lineitem)
SELECT s.station, s.hr, CASE WHEN s.w>=85 THEN 'HOUR' WHEN st.w>=590 THEN 'STATION' ELSE 'GLOBAL' END AS tier, round(CASE WHEN s.w>=85 THEN s.m WHEN st.w>=590 THEN st.m ELSE (SELECT m FROM g) END,3) AS median,
 round(exp((s.w/(s.w+50.0::DOUBLE))*ln(s.m)+(1-s.w/(s.w+50.0::DOUBLE))*ln(st.m)),3) AS blended FROM s JOIN st USING (station)""")
def _(t):
    x = t.lineitem.select(F.col("l_suppkey").alias("station"), F.col("l_linenumber").alias("hr"), F.ln("l_extendedprice").alias("lx"))
    fit = lambda keys: x.groupBy(*keys).agg(F.count(F.lit(1)).alias("w"), F.exp(F.avg("lx")).alias("median")).withColumn("sigma", F.lit(1.0))
    hour, station, everywhere = fit(["station", "hr"]), fit(["station"]), fit([])
    c = B.context_kernel(hour.select("station", "hr", F.col("w").alias("hw"), F.col("median").alias("hm")),
                         [("HOUR", hour, ["station", "hr"], 85), ("STATION", station, ["station"], 590), ("GLOBAL", everywhere, [], 0)])
    c = c.join(station.select("station", F.col("median").alias("sm")), "station")
    return c.select("station", "hr", F.col("kernel.tier").alias("tier"), F.round("kernel.median", 3).alias("median"), F.round(B.blend(F.col("hm"), F.col("sm"), F.col("hw"), 50.0), 3).alias("blended"))


SHIFTS = [-1800, -900, 0, 900, 1800]
SHIFTED = f"""{FAC}, att AS (SELECT upper_root AS root, 1 AS sgn, centre, sd, w FROM fac WHERE upper_root IS NOT NULL UNION ALL SELECT lower_root, -1, centre, sd, w FROM fac WHERE lower_root IS NOT NULL),
 sh AS (SELECT *, unnest({SHIFTS}) AS shift FROM att), sx AS (SELECT *, centre+sgn*shift AS c2 FROM sh), ss AS (SELECT root, shift, sum(w*coalesce({lid_sql('c2', 'sd', 14400.0, 1.2)},-1e6)) AS score, sum(w) AS usage FROM sx GROUP BY ALL),
 obj AS (SELECT *, round(score/usage - 0.5::DOUBLE*pow(shift/1200.0::DOUBLE,2),6) AS obj FROM ss), offs AS (SELECT root, max(usage) AS usage, CASE WHEN max(usage)<0.5 THEN 0 ELSE arg_min(shift,(-obj,abs(shift),shift)) END AS off FROM obj GROUP BY 1)"""


@query("B18_shift_grid", f"WITH {SHIFTED} SELECT root, shift, round(score,3) AS score, round(usage,4) AS usage FROM ss")
def _(t):
    s = B.shift_scores(scoring(t), SHIFTS).select("root", "usage", F.inline("scores"))
    return s.select("root", "shift", F.round("score", 3).alias("score"), F.round("usage", 4).alias("usage"))


@query("B19_apply_offsets", f"WITH {SHIFTED} SELECT ride_id, dep+coalesce(off,0) AS dep, arr+coalesce(off,0) AS arr FROM rides LEFT JOIN offs ON root=ride_id")
def _(t):
    o = B.choose_shifts(B.shift_scores(scoring(t), SHIFTS), 1200.0, 0.5)
    return B.apply_offsets(rides(t).select("ride_id", "dep", "arr"), o, "ride_id", ["dep", "arr"]).select("ride_id", F.col("dep").cast("bigint").alias("dep"), F.col("arr").cast("bigint").alias("arr"))


TWO = f"""{POST}, nw AS (SELECT *, p*exp(-(r1%5)*0.2::DOUBLE) AS e1 FROM po), n2 AS (SELECT *, e1/sum(e1) OVER (PARTITION BY rider_id) AS p2 FROM nw)"""


def two_passes(t):
    return B.reweight(post(t), lambda c: -(F.element_at(c["steps"], 1)["ride"] % 5) * 0.2)


@query("B20_two_pass_comparison", f"""
WITH {TWO}, c AS (SELECT rider_id, sum(abs(p-p2))/2 AS tv, arg_min({LABEL},(-round(p,9),{LABEL}))<>arg_min({LABEL},(-round(p2,9),{LABEL})) AS changed FROM n2 GROUP BY 1)
SELECT count(*) AS cohorts, count_if(changed)::BIGINT AS top_changed, round(avg(tv),4) AS mean_tv, round(max(tv),4) AS max_tv FROM c""")
def _(t):
    chains = F.col("chains")
    top = lambda p: F.array_min(F.transform(chains, lambda c: F.struct((-F.round(c[p], 9)).alias("p"), B.chain_label(c["steps"]).alias("label"))))["label"]
    c = two_passes(t).select((B.total(chains, lambda c: F.abs(c["p"] - c["new_p"])) / 2).alias("tv"), (top("p") != top("new_p")).alias("changed"))
    return c.agg(F.count(F.lit(1)).alias("cohorts"), F.count_if("changed").alias("top_changed"), F.round(F.avg("tv"), 4).alias("mean_tv"), F.round(F.max("tv"), 4).alias("max_tv"))


@query("B21_pass_summary", f"""
WITH {POST}, e AS (SELECT rider_id, max(mass) AS mass, -sum(p*ln(greatest(p,1e-300::DOUBLE))) AS entropy, sum(CASE WHEN legs>1 THEN p ELSE 0 END) AS via, sum(CASE WHEN e_c>3600 THEN p ELSE 0 END) AS tail FROM po GROUP BY 1)
SELECT (SELECT sum(mass)::BIGINT FROM riders) AS mass, sum(mass)::BIGINT AS finite_mass, round(sum(mass*entropy)/sum(mass),4) AS mean_entropy, round(sum(mass*via)/sum(mass),4) AS transfer_share, round(sum(mass*tail)/sum(mass),4) AS tail_share FROM e""")
def _(t):
    part = lambda name, f: B.total(F.col("chains"), f).alias(name)
    e = post(t).select(F.array_max(F.transform("chains", lambda c: c["mass"])).alias("mass"), part("entropy", lambda c: -c["p"] * F.ln(F.greatest(c["p"], F.lit(1e-300)))),
                       part("via", lambda c: F.when(c["legs"] > 1, c["p"]).otherwise(0.0)), part("tail", lambda c: F.when(c["egress_centre"] > 3600, c["p"]).otherwise(0.0)))
    w = lambda c, n: F.round(A.weighted_mean(c, "mass"), 4).alias(n)
    return e.agg(F.sum("mass").alias("finite_mass"), w("entropy", "mean_entropy"), w("via", "transfer_share"), w("tail", "tail_share")).withColumn("mass", cohorts(t).agg(F.sum("mass")).scalar())


SUB = f"""{RIDES}, nx AS (SELECT *, lag(dep) OVER (PARTITION BY from_station, to_station ORDER BY dep, ride_id) AS prev_dep FROM rides),
 tr AS (SELECT a.ride_id AS lower_root, a.from_station AS origin, a.to_station AS station, a.arr, min((b.dep,b.ride_id)) AS up FROM rides a JOIN rides b ON b.from_station=a.to_station AND b.dep>=a.arr+5 AND b.dep<=a.arr+14400 GROUP BY 1,2,3,4),
 sub AS (SELECT lower_root, origin, station, n.to_station AS dest, n.ride_id AS upper_root, tr.arr, up[1]-tr.arr AS upper, n.prev_dep-tr.arr AS raw_lower, tr.arr//1800 AS bin FROM tr JOIN nx n ON n.ride_id=up[2])"""


@staged
def substrate(t):
    """Transfers from each ride to the next departure at its last station within four hours, with the previous departure of the boarded service."""
    r = cut_lineage(rides(t).select("ride_id", "from_station", "to_station", "dep", "arr"))  # read six times below
    prev = skew.neighbour(r, ["from_station", "to_station"], ["dep", "ride_id"], skew.span("dep", MONTH_S), ["dep"], "prev")
    low = r.select(F.col("ride_id").alias("lower_root"), F.col("from_station").alias("origin"), F.col("to_station").alias("station"), "arr", (F.col("arr") + 5).alias("ready"))
    up = r.select(F.col("from_station").alias("station"), F.col("ride_id").alias("upper_root"), F.col("dep").alias("up_dep"))
    x = J.asof(low, up, ["station"], "ready", "up_dep", ["upper_root"], MONTH_S, "up", following=True, tie=["upper_root"])
    x = x.where(F.col("up.up_dep") <= F.col("arr") + 14400).select("lower_root", "origin", "station", "arr", "up.upper_root", (F.col("up.up_dep") - F.col("arr")).alias("upper"))
    p = prev.select(F.col("ride_id").alias("upper_root"), F.col("to_station").alias("dest"), F.col("prev.dep").alias("prev_dep"))
    return x.join(p, "upper_root").select("lower_root", "origin", "station", "dest", "upper_root", "arr", "upper", (F.col("prev_dep") - F.col("arr")).alias("raw_lower"), F.floor(F.col("arr") / 1800).alias("bin"))


KIND = "CASE WHEN raw_lower>0 AND raw_lower<upper THEN 'CANDIDATE_LOWER' WHEN raw_lower>=upper THEN 'CONFLICTING' WHEN raw_lower IS NULL THEN 'NO_PREVIOUS' ELSE 'ZERO' END"


def lower_kind():
    r, u = F.col("raw_lower"), F.col("upper")
    return F.when((r > 0) & (r < u), "CANDIDATE_LOWER").when(r >= u, "CONFLICTING").when(r.isNull(), "NO_PREVIOUS").otherwise("ZERO")


@query("B22_transfer_interval_substrate", f"WITH {SUB} SELECT lower_root, upper_root, upper, CASE WHEN raw_lower>0 AND raw_lower<upper THEN raw_lower ELSE 0 END AS lower, {KIND} AS kind, bin FROM sub")
def _(t):
    s = substrate(t)
    return s.select("lower_root", "upper_root", "upper", F.when(lower_kind() == "CANDIDATE_LOWER", F.col("raw_lower")).otherwise(0).alias("lower"), lower_kind().alias("kind"), "bin")


EPI = f"""{SUB}, epi AS (SELECT s.lower_root AS episode, s.station, s.dest, s.bin, r.ride_id, r.dep-s.arr AS gap, 10.0::DOUBLE+r.ride_id%20 AS sd FROM sub s JOIN rides r ON r.from_station=s.station AND r.dep>s.arr AND r.dep<=s.arr+s.upper)"""


def episodes(t):
    s = substrate(t).withColumns({"lo": F.col("arr") + 1, "hi": F.col("arr") + F.col("upper")})
    # a bucket is as long as the mean search, so that few rides of a busy station share it
    width = int(s.agg(F.avg("upper")).first()[0] or 0) + 1
    r = rides(t).select(F.col("from_station").alias("station"), "ride_id", "dep")
    x = J.interval_join(s, r, ["station"], "lo", "hi", "dep", width)
    return x.select(F.col("lower_root").alias("episode"), "station", "dest", "bin", "ride_id", (F.col("dep") - F.col("arr")).alias("gap"), (F.lit(10.0) + F.col("ride_id") % 20).alias("sd"))


@query("B23_first_boardable_episodes", f"WITH {EPI} SELECT episode, ride_id, gap, sd FROM epi")
def _(t):
    return episodes(t).select("episode", "ride_id", "gap", "sd")


LIKE = f"""{EPI}, cd AS (SELECT *, {gh_sql('gap', 'sd', 3600.0, 0.9)} AS cdf, row_number() OVER (PARTITION BY episode ORDER BY gap DESC, ride_id DESC)-1 AS skipped FROM epi),
 tm AS (SELECT *, greatest(0,cdf-coalesce(lag(cdf) OVER (PARTITION BY episode ORDER BY gap, ride_id),0))*pow(0.2::DOUBLE,skipped)*0.8::DOUBLE AS term FROM cd), lk AS (SELECT episode, station, sum(term) AS prob, sum(term*skipped)/nullif(sum(term),0) AS skips FROM tm GROUP BY ALL)"""


def likelihood(t, median=3600.0):
    e = episodes(t).withColumn("ord", F.struct("gap", "ride_id"))
    x = B.first_boardable_terms(e, "episode", "ord", "gap", "sd", F.lit(median), F.lit(0.9), F.lit(0.2))
    return x.groupBy("episode", "station").agg(F.sum("term").alias("prob"), (F.sum(F.col("term") * F.col("skipped")) / F.nullif(F.sum("term"), F.lit(0.0))).alias("skips"))


@query("B24_first_boardable_likelihood", f"WITH {LIKE} SELECT station, count(*) AS episodes, round(-sum(ln(greatest(prob,1e-12::DOUBLE))),3) AS nll, round(avg(skips),4) AS mean_skips FROM lk GROUP BY 1")
def _(t):
    nll = -F.sum(F.ln(F.greatest("prob", F.lit(1e-12))))
    return likelihood(t).groupBy("station").agg(F.count(F.lit(1)).alias("episodes"), F.round(nll, 3).alias("nll"), F.round(F.avg("skips"), 4).alias("mean_skips"))


@query("B28_chain_reweight", f"WITH {TWO} SELECT rider_id AS cohort, {LABEL} AS chain, round(p,4) AS p, round(p2,4) AS new_p FROM n2")
def _(t):
    return B.chains_of(two_passes(t), "cohort").select("cohort", B.chain_label().alias("chain"), F.round("p", 4).alias("p"), F.round("new_p", 4).alias("new_p"))
