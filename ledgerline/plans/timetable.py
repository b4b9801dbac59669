"""Fit, audit and proposal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.functions import clocks
from ledgerline.operators import assign as B
from ledgerline.operators import joins as J
from ledgerline.operators import quantiles as Q
from ledgerline.operators import reconcile as R
from ledgerline.operators import timetable as TT
from ledgerline.plans.assign import (CHAIN, EPI, FAC, LABEL, MONTH_S, OBS, POST, SHIFTED, SHIFTS, STATS, SUB, TWO, chosen, cohorts, episodes, factors, kernel_stats, observations, post, scoring,
                                     substrate, two_passes)
from ledgerline.plans.scalars import gh_sql, lncdf_sql, phi_sql
from ledgerline.plans.views import RIDERS, RIDES, riders, rides
from ledgerline.registry import query
from ledgerline.session import cut_lineage


def fit_sql(m: float) -> str:
    return f"""SELECT station, {m}::DOUBLE AS median, -sum(ln(greatest(prob,1e-12::DOUBLE))) AS nll FROM (SELECT episode, station, sum(term) AS prob FROM (SELECT *, greatest(0,cdf-coalesce(lag(cdf) OVER (PARTITION BY episode ORDER BY gap, ride_id),0))*pow(0.2::DOUBLE,skipped)*0.8::DOUBLE AS term
 FROM (SELECT *, {gh_sql('gap', 'sd', m, 0.9)} AS cdf, row_number() OVER (PARTITION BY episode ORDER BY gap DESC, ride_id DESC)-1 AS skipped FROM epi)) GROUP BY ALL) GROUP BY 1"""


@query("B25_movement_fit", f"""WITH {EPI}, g AS ({' UNION ALL '.join(fit_sql(m) for m in (1800.0, 3600.0, 7200.0))}) SELECT station, arg_min(median,(round(nll,4),median)) AS median, round(min(nll),3) AS nll, count(*) AS tried FROM g GROUP BY 1""")
def _(t):
    """Grid scan of the median over the first-boardable likelihood, per station."""
    e = cut_lineage(episodes(t)).withColumn("median", F.explode(F.array(*[F.lit(m) for m in (1800.0, 3600.0, 7200.0)])))
    e = e.withColumns({"ord": F.struct("gap", "ride_id"), "case": F.struct("episode", "median")})
    x = B.first_boardable_terms(e, "case", "ord", "gap", "sd", F.col("median"), F.lit(0.9), F.lit(0.2))
    p = x.groupBy("episode", "station", "median").agg(F.sum("term").alias("prob"))
    g = p.groupBy("station", "median").agg((-F.sum(F.ln(F.greatest("prob", F.lit(1e-12))))).alias("nll"))
    return g.groupBy("station").agg(F.min_by("median", F.struct(F.round("nll", 4), "median")).alias("median"), F.round(F.min("nll"), 3).alias("nll"), F.count(F.lit(1)).alias("tried"))


@query("B26_empirical_bayes", """
WITH b AS (SELECT l_suppkey, l_linenumber, avg(ln(l_extendedprice)) AS est, var_samp(ln(l_extendedprice))/count(*) AS v FROM lineitem GROUP BY ALL HAVING count(*)>1), g AS (SELECT l_suppkey, avg(est) AS m, greatest(0,var_pop(est)-avg(v)) AS tau2 FROM b GROUP BY 1)
SELECT l_suppkey, l_linenumber, round(CASE WHEN tau2>0 THEN tau2/(tau2+v)*est+(1-tau2/(tau2+v))*m ELSE m END,6) AS shrunk FROM b JOIN g USING (l_suppkey)""")
def _(t):
    b = t.lineitem.withColumn("lx", F.ln("l_extendedprice")).groupBy("l_suppkey", "l_linenumber").agg(F.avg("lx").alias("est"), F.var_pop("lx").alias("vp"), F.count(F.lit(1)).alias("n")).where("n > 1")
    b = b.withColumn("v", F.col("vp") / (F.col("n") - 1))
    return B.empirical_bayes(b, ["l_suppkey"], "est", "v").select("l_suppkey", "l_linenumber", F.round("shrunk", 6).alias("shrunk"))


def pdf_sql(z):
    return f"(exp(-({z})*({z})/2)/sqrt(2*pi()))"


@query("B27_truncated_moment_step", f"""
WITH {OBS}, c AS (SELECT ctx, lower, upper, sum(w) AS w FROM obs GROUP BY ALL), z AS (SELECT *, CASE WHEN lower>0 THEN (ln(greatest(lower,1e-9))-ln(7200.0::DOUBLE))/0.8::DOUBLE END AS a, (ln(upper)-ln(7200.0::DOUBLE))/0.8::DOUBLE AS b FROM c),
 m AS (SELECT *, coalesce({pdf_sql('a')},0) AS pa, coalesce({phi_sql('a')},0) AS ca, coalesce(a*{pdf_sql('a')},0) AS apa, {pdf_sql('b')} AS pb, {phi_sql('b')} AS cb FROM z), e AS (SELECT ctx, w, (pa-pb)/greatest(cb-ca,1e-9) AS sh, (apa-b*pb)/greatest(cb-ca,1e-9) AS q FROM m),
 s AS (SELECT ctx, sum(w) AS w, sum(w*(ln(7200.0::DOUBLE)+0.8::DOUBLE*sh)) AS s1, sum(w*(pow(ln(7200.0::DOUBLE),2)+2*ln(7200.0::DOUBLE)*0.8::DOUBLE*sh+0.64::DOUBLE*(1+q))) AS s2 FROM e GROUP BY 1)
SELECT ctx, round(exp(s1/w),2) AS median, round(sqrt(greatest(1e-8,s2/w-pow(s1/w,2))),4) AS sigma FROM s""")
def _(t):
    m = TT.truncated_moments(observations(t), ["ctx"], F.lit(7200.0), F.lit(0.8))
    return m.select("ctx", F.round("median", 2).alias("median"), F.round("sigma", 4).alias("sigma"))


@query("B29_timetable_consistency", f"""
WITH {FAC}, g AS (SELECT factor, sum(w) AS mass, sum(w*centre)/sum(w) AS mg, sum(w*{phi_sql('(centre/greatest(sd,1e-6))')})/sum(w) AS pp, sum(CASE WHEN centre<0 THEN w ELSE 0 END) AS inf, sum(CASE WHEN centre+1.96*sd<0 THEN w ELSE 0 END) AS imp FROM fac GROUP BY 1),
 v AS (SELECT factor, centre, sum(w) AS w FROM fac GROUP BY 1,2), c AS (SELECT *, sum(w) OVER (PARTITION BY factor ORDER BY centre) AS u, sum(w) OVER (PARTITION BY factor) AS tot FROM v),
 q AS (SELECT factor, min(centre) FILTER (u>=tot*0.1::DOUBLE) AS q10, min(centre) FILTER (u>=tot*0.5::DOUBLE) AS q50, min(centre) FILTER (u>=tot*0.9::DOUBLE) AS q90 FROM c GROUP BY 1)
SELECT factor, round(mass,3) AS mass, round(mg,1) AS mean_gap, round(pp,4) AS p_positive, round(inf,4) AS infeasible, round(imp,4) AS impossible95, q10, q50, q90 FROM g JOIN q USING (factor)""")
def _(t):
    cells = cut_lineage(B.factor_cells(scoring(t), lambda root, centre, sd: centre, TT.CONSISTENCY))
    c = TT.consistency(cells.withColumn("centre", F.col("cell").cast("double")), ["kind"], 3600.0).withColumn("factor", B.factor_name()).drop("kind")
    r = {"mass": 3, "mean_gap": 1, "p_positive": 4, "infeasible": 4, "impossible95": 4}
    return c.withColumns({k: F.round(k, n) for k, n in r.items()})


ORD = f"{FAC}, od_ AS (SELECT *, CASE factor WHEN 'transfer' THEN 30.0::DOUBLE ELSE 45.0::DOUBLE END AS tau FROM fac), ox AS (SELECT *, -centre/tau AS x FROM od_), ol AS (SELECT *, CASE WHEN x>50 THEN x ELSE ln(1+exp(least(x,50))) END AS loss FROM ox)"


@query("B30_heldout_ordering_score", f"""
WITH {ORD} SELECT factor, round(sum(w),3) AS mass, round(sum(CASE WHEN centre>=0 THEN w ELSE 0 END)/sum(w),4) AS feasible, round(sum(w*{phi_sql('(centre/greatest(sd,1e-6))')})/sum(w),4) AS probability, round(sum(w*loss)/sum(w),4) AS loss FROM ol GROUP BY 1""")
def _(t):
    s = TT.ordering_scores(factors(t), ["factor"])
    return s.select("factor", F.round("mass", 3).alias("mass"), *[F.round(c, 4).alias(c) for c in ("feasible", "probability", "loss")])


@query("B31_chain_smoothing")
def _(t):
    """Gaussian smoothing of ship days along each order; a dense solve checks it in the tests."""
    d = F.unix_date(F.col("l_shipdate").cast("date"))
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("root"), F.col("l_linenumber").alias("seq")).agg(
        F.when(F.min("l_returnflag") != "R", F.min(d).cast("double")).alias("anchor"), (F.min("l_quantity") + 1.0).alias("anchor_sd"))
    x = x.withColumns({"lag": F.lit(3.0), "lag_sd": F.lit(2.0)})
    return TT.smooth_roots(x).select("root", "seq", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "forward")


@query("B32_physical_service_groups", f"""
WITH {RIDES}, r AS (SELECT ride_id, line, to_station, arr//86400 AS day, (arr-dep)::DOUBLE AS w FROM rides), g AS (SELECT line, to_station, day, count(*) AS members, sum(w) AS sw, sum(w*ln(w)) AS wl FROM r GROUP BY 1,2,3)
SELECT ride_id, members, round(w/sw,6) AS share, round(ln(sw)-wl/sw,6) AS entropy FROM r JOIN g USING (line,to_station,day)""")
def _(t):
    r = rides(t).select("ride_id", "line", "to_station", F.floor(F.col("arr") / clocks.DAY_S).alias("day"), (F.col("arr") - F.col("dep")).cast("double").alias("w"))
    return TT.service_groups(r, ["line", "to_station", "day"], "w").select("ride_id", "members", F.round("share", 6).alias("share"), F.round("entropy", 6).alias("entropy"))


@query("B33_soft_order_objective", f"""
WITH {ORD}, g AS (SELECT *, w*loss AS wl, w/(1+exp(-greatest(-50,least(x,50))))/tau AS gr FROM ol), u AS (SELECT upper_root AS root, 'departure' AS event, wl, -gr AS gr FROM g WHERE upper_root IS NOT NULL UNION ALL SELECT lower_root, 'arrival', wl, gr FROM g WHERE lower_root IS NOT NULL)
SELECT root, event, round(sum(wl),4) AS loss, round(sum(gr),6) AS grad FROM u GROUP BY 1,2""")
def _(t):
    return TT.soft_order_objective(scoring(t)).select("root", "event", F.round("loss", 4).alias("loss"), F.round("grad", 6).alias("grad"))


PROP = f"""{SHIFTED}, z AS (SELECT root, obj AS zero FROM obj WHERE shift=0), pr AS (SELECT root, shift, round(obj-zero,6) AS gain, usage FROM obj JOIN z USING (root) WHERE shift<>0 AND obj-zero>0.01 AND usage>=0.2),
 best AS (SELECT * FROM pr QUALIFY rank() OVER (PARTITION BY root ORDER BY gain DESC)=1), prop AS (SELECT root, max(shift) AS shift, max(gain) AS gain, max(usage) AS usage FROM best GROUP BY 1 HAVING count(DISTINCT shift>0)=1)"""


def proposals(t):
    return B.clear_shifts(B.shift_scores(scoring(t), SHIFTS), 1200.0, 0.01, 0.2)


@query("B36_sparse_update_proposal", f"WITH {PROP} SELECT root, shift, round(gain,4) AS gain FROM prop")
def _(t):
    return proposals(t).select("root", "shift", F.round("gain", 4).alias("gain"))


@query("B37_complexity_frontier", "WITH v AS (SELECT floor(c_acctbal/50)::BIGINT AS value FROM customer), d AS (SELECT value, count(*) AS n, sum(value) AS s FROM v GROUP BY 1) SELECT value, sum(n) OVER w::BIGINT AS set_size, sum(s) OVER w::BIGINT AS set_total FROM d WINDOW w AS (ORDER BY value DESC)".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT").replace("sum(s) OVER w::BIGINT", "(sum(s) OVER w)::BIGINT"))
def _(t):
    return TT.complexity_frontier(t.customer.select(F.floor(F.col("c_acctbal") / 50).alias("value")), "value", 20.0)


ANCHOR = f"""{RIDES}, {RIDERS}, ex AS (SELECT to_station, exit AS tap_at FROM riders GROUP BY ALL), nn AS (SELECT r.ride_id, r.to_station, r.arr, (SELECT min(abs(tap_at-r.arr)) FROM ex WHERE ex.to_station=r.to_station AND abs(tap_at-r.arr)<=86400) AS before_gap, (SELECT min(abs(tap_at-r.arr-1800)) FROM ex WHERE ex.to_station=r.to_station AND abs(tap_at-r.arr-1800)<=86400) AS after_gap FROM rides r)"""


def anchors(t):
    """Distance of each ride's arrival, and of the arrival half an hour later, to the nearest exit tap.

    A time line reads its rows twice, so the rides and what the first lookup found are written before the next step.
    """
    pulses = riders(t).select("to_station", F.col("exit").alias("at")).distinct()
    x = cut_lineage(rides(t).select("ride_id", "to_station", "arr"))
    x = J.nearest(x, pulses, ["to_station"], "arr", "at", [], clocks.DAY_S, MONTH_S, "h1", tie=["at"])
    x = cut_lineage(x.select("ride_id", "to_station", F.abs(F.col("h1.at") - F.col("arr")).alias("before_gap"), (F.col("arr") + 1800).alias("moved")))
    x = J.nearest(x, pulses, ["to_station"], "moved", "at", [], clocks.DAY_S, MONTH_S, "h2", tie=["at"])
    return x.select("ride_id", "to_station", "before_gap", F.abs(F.col("h2.at") - F.col("moved")).alias("after_gap"))


@query("B38_anchor_check", f"WITH {ANCHOR} SELECT ride_id, before_gap, after_gap FROM nn")
def _(t):
    return anchors(t).select("ride_id", "before_gap", "after_gap")


@query("B39_consensus_filter", f"""
WITH {ANCHOR} SELECT CASE WHEN before_gap IS NULL OR after_gap IS NULL THEN 'NO_ANCHOR' WHEN after_gap>before_gap THEN 'WORSE' WHEN after_gap>7200 THEN 'TOO_FAR' ELSE 'ACCEPTED' END AS reason, count(*) AS n FROM nn GROUP BY 1""")
def _(t):
    a = anchors(t)
    r = R.evidence_class([("NO_ANCHOR", F.col("before_gap").isNull() | F.col("after_gap").isNull()), ("WORSE", F.col("after_gap") > F.col("before_gap")), ("TOO_FAR", F.col("after_gap") > 7200)], "ACCEPTED")
    return a.groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("B40_directional_transfer_evidence", f"""
WITH {SUB}, k AS (SELECT DISTINCT station, dest FROM sub), n AS (SELECT station, count(*) AS k FROM k GROUP BY 1), x AS (SELECT s.station, k.dest, s.upper, 1.0::DOUBLE/n.k AS w FROM sub s JOIN k USING (station) JOIN n USING (station)),
 v AS (SELECT station, dest, upper, sum(w) AS w FROM x GROUP BY ALL), c AS (SELECT *, round(sum(w) OVER (PARTITION BY station, dest ORDER BY upper),6) AS u, round(sum(w) OVER (PARTITION BY station, dest),6) AS tot FROM v)
SELECT station, dest, round(max(tot),4) AS mass, min(upper) FILTER (u>=tot*0.5::DOUBLE-1e-6) AS median_gap FROM c GROUP BY ALL""")
def _(t):
    """Each transfer is shared over the onward directions of its station; equal gaps are combined before the share."""
    s = cut_lineage(substrate(t).groupBy("station", "dest", "upper").agg(F.count(F.lit(1)).alias("n")))
    k = s.select("station", "dest").distinct()
    cells = s.groupBy("station", "upper").agg(F.sum("n").alias("n"))
    x = J.split_over_candidates(cells, ["station"], k, "station").withColumn("w", F.round(F.col("n") * F.col("share"), 9))
    mass = x.groupBy("station", "dest").agg(F.round(F.sum("w"), 4).alias("mass"))
    # all directions of a station share one distribution shape, so counts give the same median as shares
    q = Q.quantiles(x, ["station", "dest"], "upper", 1800.0, {"median_gap": 0.5}, kind="weighted", weight="n")
    return mass.join(q, ["station", "dest"])


CONS = f"""{CHAIN}, cs AS (SELECT cohort, mass, exit, entry, bs FROM ch WHERE reason='FEASIBLE_COMPLETE_CHAIN'),
 con AS (SELECT cohort, mass, 'ABS_LOWER' AS kind, bs[1]['r'] AS root, NULL::BIGINT AS other, (entry+15)::BIGINT AS bound, bs[1]['d']-(entry+15) AS slack FROM cs
  UNION ALL SELECT cohort, mass, 'DIFF_LOWER', bs[i+1]['r'], bs[i]['r'], 5, bs[i+1]['d']-bs[i]['a']-5 FROM (SELECT *, unnest(range(1,len(bs))) AS i FROM cs)
  UNION ALL SELECT cohort, mass, 'ABS_UPPER', bs[-1]['r'], NULL, exit-15, exit-15-bs[-1]['a'] FROM cs)"""


def constraints(t):
    c = cut_lineage(chosen(t).where("ok"))
    first, last = F.element_at("chain", 1), F.element_at("chain", -1)
    none = F.lit(None).cast("bigint")
    row = lambda kind, root, other, bound, slack: F.struct(F.lit(kind).alias("kind"), root.alias("root"), other.alias("other"), bound.cast("bigint").alias("bound"), slack.cast("bigint").alias("slack"))
    ends = F.array(row("ABS_LOWER", first["ride"], none, F.col("entry") + B.ACCESS_MIN_S, first["dep"] - F.col("entry") - B.ACCESS_MIN_S),
                   row("ABS_UPPER", last["ride"], none, F.col("exit") - B.EGRESS_MIN_S, F.col("exit") - B.EGRESS_MIN_S - last["arr"]))
    pair = F.zip_with(F.slice("chain", 1, F.size("chain") - 1), F.slice("chain", 2, F.size("chain")), lambda a, b: row(
        "DIFF_LOWER", b["ride"], a["ride"], F.lit(B.TRANSFER_MIN_S), b["dep"] - a["arr"] - B.TRANSFER_MIN_S))
    return c.select("cohort", "mass", F.explode(F.concat(ends, pair)).alias("c")).select("cohort", "mass", "c.*")


@query("B41_difference_constraints", f"WITH {CONS} SELECT cohort, mass, kind, root, other, bound, slack FROM con")
def _(t):
    return constraints(t)


@query("B42_event_offsets", f"""
WITH {CONS}, g AS (SELECT root, sum(mass)::BIGINT AS w, sum(mass*(CASE kind WHEN 'ABS_UPPER' THEN slack ELSE -slack END)/2)/sum(mass) AS m FROM con GROUP BY 1) SELECT root, w, round(greatest(-180,least(180,m*w/(w+250.0::DOUBLE))),6) AS offset_s FROM g""")
def _(t):
    x = constraints(t).withColumn("target", F.when(F.col("kind") == "ABS_UPPER", F.col("slack")).otherwise(-F.col("slack")) / 2)
    return TT.event_offsets(x, ["root"], "target", "mass").select("root", "w", F.round("offset", 6).alias("offset_s"))


@query("B48_prior_mass_update", f"""
WITH {STATS}, f AS (SELECT factor, (sum_log+20*ln(14400.0::DOUBLE))/(w+20) AS m, (sum_log2+20*(1.44+pow(ln(14400.0::DOUBLE),2)))/(w+20) AS s FROM st) SELECT factor, round(exp(m),2) AS median, round(least(2.5,greatest(0.12,sqrt(greatest(1e-8,s-m*m)))),4) AS sigma FROM f""")
def _(t):
    u = TT.prior_mass_update(kernel_stats(t), 14400.0, 1.2, 20.0)
    return u.select("factor", F.round("median", 2).alias("median"), F.round("sigma", 4).alias("sigma"))


@query("B49_raw_weight_membership", f"""
WITH {FAC}, s AS (SELECT coalesce(upper_root,lower_root)%40 AS movement, sum(w) AS raw, exp(sum(w*ln(centre))/sum(w)) AS m FROM fac WHERE centre>0 AND w>0 GROUP BY 1), g AS (SELECT exp(sum(w*ln(centre))/sum(w)) AS m FROM fac WHERE centre>0 AND w>0)
SELECT movement, raw>=50 AS own_kernel, round(CASE WHEN raw>=50 THEN s.m ELSE (SELECT m FROM g) END,2) AS median FROM s""")
def _(t):
    fit = lambda s: s.withColumns({"median": F.exp(F.col("sum_log") / F.col("w")), "sigma": F.lit(1.0)})
    # a few sums per movement; those of all movements are their sums
    sums = cut_lineage(B.log_sums(scoring(t), 40).groupBy(F.col("cell").alias("movement")).agg(*[F.sum(c).alias(c) for c in ("w", "sum_log", "sum_log2")]))
    own, every = fit(sums), fit(sums.agg(*[F.sum(c).alias(c) for c in ("w", "sum_log", "sum_log2")]))
    k = B.context_kernel(own.select("movement"), [("OWN", own, ["movement"], 50.0), ("GLOBAL", every, [], 0.0)])
    return k.select("movement", (F.col("kernel.tier") == "OWN").alias("own_kernel"), F.round("kernel.median", 2).alias("median"))


@query("B50_movement_mass_shift", f"""
WITH {TWO}, m AS (SELECT (r1%6)||'->'||coalesce((r2%6)::VARCHAR,'-') AS movement, sum(mass*p) AS b, sum(mass*p2) AS a FROM n2 GROUP BY 1) SELECT movement, round(b,4) AS before_mass, round(a,4) AS after_mass, round(a-b,4) AS delta FROM m""")
def _(t):
    ride = lambda i: (F.try_element_at("steps", F.lit(i))["ride"] % 6).cast("string")
    x = B.chains_of(two_passes(t), "cohort").withColumn("movement", F.concat(ride(1), F.lit("->"), F.coalesce(ride(2), F.lit("-"))))
    m = x.groupBy("movement").agg(F.sum(F.col("mass") * F.col("p")).alias("b"), F.sum(F.col("mass") * F.col("new_p")).alias("a"))
    return m.select("movement", F.round("b", 4).alias("before_mass"), F.round("a", 4).alias("after_mass"), F.round(F.col("a") - F.col("b"), 4).alias("delta"))


@query("A49_transfer_observability", f"""
WITH {SUB} SELECT station, dest, count(*) AS rows_, coalesce(count_if(raw_lower>0 AND raw_lower<upper),0)::BIGINT AS bounded, count(DISTINCT upper_root) AS anchors, count(*)>=20 AS fit_allowed FROM sub GROUP BY ALL""")
def _(t):
    s = substrate(t)
    return s.groupBy("station", "dest").agg(F.count(F.lit(1)).alias("rows_"), F.count_if((F.col("raw_lower") > 0) & (F.col("raw_lower") < F.col("upper"))).alias("bounded"),
                                            F.count_distinct("upper_root").alias("anchors"), (F.count(F.lit(1)) >= 20).alias("fit_allowed"))


DIRECT = f"""{RIDES}, {RIDERS}, dp AS (SELECT rider_id, mass, ride_id, (dep-entry)::DOUBLE AS g, (exit-arr)::DOUBLE AS e FROM riders p JOIN rides r ON r.from_station=p.from_station AND r.to_station=p.to_station AND dep BETWEEN entry AND exit)"""


def boot_sql() -> str:
    parts = ["k0 AS (SELECT 14400.0::DOUBLE AS am, 1.2::DOUBLE AS asg, 14400.0::DOUBLE AS em, 1.2::DOUBLE AS es)"]
    lp = lambda x, m, s: f"(-ln({x}*{s}*sqrt(2*pi())) - 0.5*pow((ln({x})-ln({m}))/{s},2))"
    for n in (1, 2, 3):
        parts.append(f"s{n} AS (SELECT dp.*, {lp('g', 'am', 'asg')}+{lp('e', 'em', 'es')} AS sc FROM dp, k{n-1} WHERE g>0 AND e>0)")
        parts.append(f"b{n} AS (SELECT * FROM s{n} QUALIFY row_number() OVER (PARTITION BY rider_id ORDER BY -round(sc,9), ride_id)=1)")
        fit = lambda x: f"sum(mass*ln({x}))/sum(mass)"
        q = lambda x: f"sum(mass*ln({x})*ln({x}))/sum(mass)"
        sg = lambda x: f"least(2.5,greatest(0.12,sqrt(greatest(1e-8,{q(x)}-pow({fit(x)},2)))))"
        parts.append(f"k{n} AS (SELECT exp({fit('g')}) AS am, {sg('g')} AS asg, exp({fit('e')}) AS em, {sg('e')} AS es FROM b{n})")
    out = " UNION ALL ".join(f"SELECT {n}::INT AS round, 'access' AS factor, round(am,2) AS median, round(asg,4) AS sigma FROM k{n} UNION ALL SELECT {n}, 'egress', round(em,2), round(es,4) FROM k{n}" for n in (1, 2, 3))
    return f"WITH {DIRECT}, {', '.join(parts)} {out}"


@query("B46_kernel_bootstrap", boot_sql())
def _(t):
    k = TT.bootstrap_kernels(cohorts(t), rides(t).select("ride_id", *B.OD, "dep", "arr"), B.OD, (14400.0, 1.2), 3)
    return k.withColumns({"median": F.round("median", 2), "sigma": F.round("sigma", 4)})


@query("B47_schedule_likelihood_scan", f"""
WITH {RIDES}, {RIDERS}, c AS (SELECT ride_id, from_station, to_station, dep, unnest([-7200,-3600,0,3600,7200]) AS shift FROM rides), x AS (SELECT c.ride_id, shift, mass, (dep+shift-entry)::DOUBLE AS gap FROM c JOIN riders p ON p.from_station=c.from_station AND p.to_station=c.to_station AND entry<dep+shift AND entry>=dep+shift-28800),
 s AS (SELECT ride_id, shift, sum(mass) AS mass, sum(mass*(-ln(gap*0.9*sqrt(2*pi())) - 0.5*pow((ln(gap)-ln(7200.0::DOUBLE))/0.9::DOUBLE,2))) AS score FROM x GROUP BY ALL)
SELECT ride_id, max(mass)::BIGINT AS mass, arg_min(shift,(-round(score/mass,9),abs(shift),shift))::INT AS best_shift, abs(arg_min(shift,(-round(score/mass,9),abs(shift),shift)))::INT AS abs_error FROM s GROUP BY 1""")
def _(t):
    return TT.schedule_scan(rides(t).select("ride_id", *B.OD, "dep"), cohorts(t), B.OD, [-7200, -3600, 0, 3600, 7200], 28800, 7200.0, 0.9)


@query("B52_hazard_weighted_boarding", f"""
WITH {RIDES}, {RIDERS}, hp AS (SELECT rider_id, mass, ride_id, (dep-entry)::DOUBLE AS g, (exit-arr)::DOUBLE AS e FROM riders p JOIN rides r ON r.from_station=p.from_station AND dep BETWEEN entry+15 AND exit),
 c AS (SELECT *, {lncdf_sql('g', 14400.0, 1.2)} AS cdf, row_number() OVER w AS j FROM hp WINDOW w AS (PARTITION BY rider_id ORDER BY g, ride_id)), d AS (SELECT *, greatest(0,cdf-coalesce(lag(cdf) OVER (PARTITION BY rider_id ORDER BY g, ride_id),0))*pow(0.2::DOUBLE,-j) AS tt FROM c),
 b AS (SELECT *, 0.8::DOUBLE*pow(0.2::DOUBLE,j)*sum(tt) OVER (PARTITION BY rider_id ORDER BY g, ride_id ROWS UNBOUNDED PRECEDING) AS boarding FROM d),
 s AS (SELECT rider_id, mass, ride_id, boarding, ln(greatest(boarding,1e-12::DOUBLE)) + (-ln(e*1.2*sqrt(2*pi())) - 0.5*pow((ln(e)-ln(14400.0::DOUBLE))/1.2::DOUBLE,2)) AS score FROM b WHERE e>=15)
SELECT rider_id AS cohort, ride_id, round(boarding,6) AS boarding, round(score,4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY rider_id ORDER BY score DESC, ride_id)<=8""")
def _(t):
    """All departures of the entry station compete; the best eight per cohort are kept."""
    h = TT.hazard_beams(cohorts(t), rides(t).select("from_station", "ride_id", "dep", "arr"), ["from_station"], (14400.0, 1.2), 0.2, 8, B.ACCESS_MIN_S, B.EGRESS_MIN_S)
    return h.select("cohort", "ride_id", F.round("boarding", 6).alias("boarding"), F.round("score", 4).alias("score"))
