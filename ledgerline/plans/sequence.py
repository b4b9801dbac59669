"""Window and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.functions import clocks
from ledgerline.operators import aggregates as A
from ledgerline.operators import joins as J
from ledgerline.operators import quantiles as Q
from ledgerline.operators import sequence as S
from ledgerline.plans.views import RIDES, TAPS, rides, taps
from ledgerline.registry import query

DAY_US = clocks.DAY_S * 1_000_000
WEEK_S = 7 * clocks.DAY_S

PAIRS = f"""{TAPS}, prev AS (SELECT *, lag(event_id) OVER w AS p_id, lag(us) OVER w AS p_us, lag(status) OVER w AS p_status, lag(station) OVER w AS p_station, lag(line) OVER w AS p_line
   FROM taps WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 pairs AS (SELECT p_id AS entry_event_id, p_station AS entry_station, p_line AS entry_line, p_us AS entry_us, event_id AS exit_event_id, station AS exit_station, line AS exit_line, us AS exit_us, us-p_us AS duration_us
   FROM prev WHERE status=0 AND p_status=1 AND us-p_us BETWEEN 0 AND 28800000000)"""


def pairs(t):
    return S.pair_entry_exit(taps(t), "user_id", ["us", "event_id"], "us", "status", ["event_id", "station", "line"], skew.span("us", DAY_US))


@query("W01_entry_exit_pairing", f"WITH {PAIRS} SELECT * FROM pairs")
def _(t):
    return pairs(t)


@query("W02_exactly_two_events", f"""
WITH {TAPS}, u AS (SELECT user_id*31+day(ts) AS card, * FROM taps), k AS (SELECT card FROM u GROUP BY 1 HAVING count(*)=2),
 p AS (SELECT *, lag(station) OVER w AS ps, lag(us) OVER w AS pu, lag(status) OVER w AS pst FROM u JOIN k USING (card) WINDOW w AS (PARTITION BY card ORDER BY us, event_id))
SELECT ps AS entry_station, station AS exit_station, us-pu AS duration_us FROM p WHERE status=0 AND pst=1""")
def _(t):
    u = taps(t).withColumn("card", F.col("user_id") * 31 + F.dayofmonth("ts"))
    return S.exactly_two(u, "card", ["us", "event_id"], "status", "us", ["station"])


@query("W03_strict_adjacent_pairing", f"""
WITH {TAPS}, x AS (SELECT *, us//600000000 AS tick FROM taps WHERE status IS NOT NULL), y AS (SELECT *, count(*) OVER (PARTITION BY user_id, tick) AS c FROM x),
 p AS (SELECT *, lag(event_id) OVER w AS p_id, lag(status) OVER w AS ps, lag(tick) OVER w AS pt, lag(c) OVER w AS pc FROM y WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id))
SELECT p_id AS entry_event_id, event_id AS exit_event_id, (tick-pt)*600 AS duration_s FROM p WHERE status=0 AND ps=1 AND c=1 AND pc=1 AND (tick-pt)*600<=21600""")
def _(t):
    x = taps(t).where("status is not null").withColumn("tick", F.floor(F.col("us") / 600_000_000))
    x = skew.chunked(x, ["user_id"], ["tick", "event_id"], skew.span("tick", 144), local=S.repeated_times("tick"),
                     near={"prev": (["event_id", "status", "tick", "repeated"], False)})
    gap = (F.col("tick") - F.col("prev.tick")) * 600
    hit = (F.col("status") == 0) & (F.col("prev.status") == 1) & ~F.col("repeated") & ~F.col("prev.repeated") & (gap <= S.MAX_FARE_JOURNEY_S)
    return x.where(hit).select(F.col("prev.event_id").alias("entry_event_id"), F.col("event_id").alias("exit_event_id"), gap.alias("duration_s"))


BARRIER = f"""{TAPS}, b0 AS (SELECT *, us//600000000*600 AS tick, CASE WHEN status=1 THEN 'ENTRY' WHEN status=0 THEN 'EXIT' ELSE 'BARRIER' END AS kind FROM taps),
 b1 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id, tick)>1 THEN 'BARRIER' ELSE kind END AS role, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) AS pos FROM b0),
 b2 AS (SELECT *, lag(role) OVER w AS p_role, lag(tick) OVER w AS p_tick, lag(station) OVER w AS p_station, lag(line) OVER w AS p_line, lag(pos) OVER w AS p_pos FROM b1 WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)),
 seg AS (SELECT user_id, p_station AS entry_station, p_line AS entry_line, p_tick AS entry_s, p_pos AS entry_pos, station AS exit_station, line AS exit_line, tick AS exit_s, pos AS exit_pos FROM b2 WHERE role='EXIT' AND p_role='ENTRY' AND tick-p_tick<=21600)"""


def segments(t):
    x = taps(t).withColumn("tick", F.floor(F.col("us") / 600_000_000) * 600)
    x = x.withColumn("kind", F.when(F.col("status") == 1, "ENTRY").when(F.col("status") == 0, "EXIT").otherwise("BARRIER"))
    return S.barrier_pairs(x, "user_id", "tick", "event_id", "kind", ["station", "line"], skew.span("tick", clocks.DAY_S))


@query("W04_barrier_pairing", f"WITH {BARRIER} SELECT * EXCLUDE (user_id) FROM seg")
def _(t):
    return segments(t).drop("user_id")


@query("W05_blocked_users", f"WITH {TAPS} SELECT event_id, station FROM taps WHERE user_id NOT IN (SELECT user_id FROM taps WHERE event_type='error' AND value>150)")
def _(t):
    x = taps(t)
    return S.drop_blocked(x, x.where("event_type = 'error' and value > 150"), "user_id").select("event_id", "station")


#: Two pairs of lines per station, half an hour apart at most, two days at every third; every fifth ends on a day.
TRANSFERS = [S.TransferRule(s, [(s % 5, (s + 1) % 5), (s % 5, (s + 2) % 5)], 19723, 19740 if s % 5 == 0 else None, 172800 if s % 3 == 0 else S.MAX_STITCH_GAP_S) for s in range(23)]


@query("W06_transitive_stitching", f"""
WITH {BARRIER}, r AS (SELECT s AS station, s%5 AS a, (s+k)%5 AS b, CASE WHEN s%3=0 THEN 172800 ELSE 1800 END AS max_gap, CASE WHEN s%5=0 THEN 19740 ELSE 999999 END AS last_day FROM range(23) x(s), range(1,3) y(k)),
 s1 AS (SELECT *, lag(exit_pos) OVER w AS pp, lag(exit_s) OVER w AS px, lag(exit_line) OVER w AS pl, lag(exit_station) OVER w AS pst FROM seg WINDOW w AS (PARTITION BY user_id ORDER BY entry_s, entry_pos)),
 s2 AS (SELECT *, CASE WHEN entry_s-px>0 AND pst=entry_station AND entry_pos=pp+1 AND EXISTS (SELECT 1 FROM r WHERE r.station=entry_station AND entry_s-px<=max_gap AND entry_s//86400 BETWEEN 19723 AND last_day
   AND (pl, entry_line) IN ((a, b), (b, a))) THEN 0 ELSE 1 END AS nw FROM s1),
 s3 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY entry_s, entry_pos ROWS UNBOUNDED PRECEDING) AS j FROM s2)
SELECT arg_min(entry_station, entry_s) AS entry_station, arg_min(entry_line, entry_s) AS entry_line, min(entry_s) AS entry_s, arg_max(exit_station, exit_s) AS exit_station, arg_max(exit_line, exit_s) AS exit_line, max(exit_s) AS exit_s, count(*)-1 AS transfers
FROM s3 GROUP BY user_id, j""")
def _(t):
    return S.stitch(segments(t), "user_id", skew.span("entry_s", clocks.DAY_S), S.transfer_rule(TRANSFERS), ["station", "line"])


@query("W07_representative_event", f"""
WITH {TAPS}, r AS (SELECT station, line, us, row_number() OVER (PARTITION BY station, line ORDER BY us) AS k, count(*) OVER (PARTITION BY station, line) AS n FROM taps)
SELECT station, line, us AS upper_middle_us FROM r WHERE k = n//2+1""")
def _(t):
    return Q.quantiles(taps(t), ["station", "line"], "us", float(DAY_US), {"upper_middle_us": 0.5}, kind="upper_middle")


@query("W08_consecutive_dedupe", f"""
WITH {TAPS}, x AS (SELECT *, lag(line) OVER (PARTITION BY user_id ORDER BY us, event_id) AS pl, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM taps)
SELECT event_id, line FROM x WHERE rn=1 OR pl IS DISTINCT FROM line""")
def _(t):
    return S.consecutive_distinct(taps(t), ["user_id"], ["us", "event_id"], skew.span("us", DAY_US), "line").select("event_id", "line")


STOPS = """stops AS (SELECT (l_suppkey%30)::INT AS route, l_orderkey AS trip, l_linenumber AS seq, (l_partkey%12)::INT AS stop FROM lineitem)"""


def stops(t):
    return t.lineitem.select((F.col("l_suppkey") % 30).cast("int").alias("route"), F.col("l_orderkey").alias("trip"),
                             F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 12).cast("int").alias("stop"))


@query("W09_canonical_sequence", f"""
WITH {STOPS}, v AS (SELECT route, trip, stop, min(seq) AS seq, count(*) AS c FROM stops GROUP BY ALL), z AS (SELECT route, trip, count(*) AS d, sum(c) AS l FROM v GROUP BY ALL),
 b AS (SELECT route, arg_min(trip, (-d,-l,trip)) AS trip FROM z GROUP BY 1)
SELECT v.route, v.trip, v.stop, v.seq FROM v JOIN b USING (route, trip)""")
def _(t):
    return S.canonical_sequence(stops(t), "route", "trip", "seq", "stop")


@query("W10_traversal_expansion", f"""
WITH st AS (SELECT l_orderkey AS trip, l_shipdate::DATE AS day, l_linenumber AS seq, min(l_suppkey%20)::INT AS pos FROM lineitem GROUP BY 1,2,3),
 x AS (SELECT *, lead(pos) OVER (PARTITION BY trip ORDER BY seq, day, pos) AS nx FROM st)
SELECT trip, day, unnest(range(least(pos,nx),greatest(pos,nx)))::INT AS segment, (nx>pos) AS outbound FROM x WHERE nx<>pos""")
def _(t):
    st = t.lineitem.groupBy(F.col("l_orderkey").alias("trip"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_linenumber").alias("seq")).agg(
        F.min(F.col("l_suppkey") % 20).cast("int").alias("pos"))
    x = skew.neighbour(st, ["trip"], ["seq", "day", "pos"], None, ["pos"], "nx", following=True)
    return J.expand_segments(x.where("nx.pos <> pos").withColumn("to_pos", F.col("nx.pos")), "pos", "to_pos").select("trip", "day", "segment", "outbound")


@query("W11_clock_rollover", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS d, (l_orderkey%30)*3600+(l_partkey%60)*60 AS sec FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, (d + (sec//86400)::INT)::DATE AS service_date, ((sec%86400)//3600)::INT AS hr FROM x""")
def _(t):
    sec = (F.col("l_orderkey") % 30) * 3600 + (F.col("l_partkey") % 60) * 60
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.date_add(F.col("l_shipdate").cast("date"), F.floor(sec / clocks.DAY_S).cast("int")).alias("service_date"),
                             F.floor(sec % clocks.DAY_S / 3600).cast("int").alias("hr"))


@query("W12_run_times", f"""
WITH {RIDES}, x AS (SELECT *, lead(dep) OVER (PARTITION BY line, from_station ORDER BY dep, ride_id) - arr AS run FROM rides)
SELECT ride_id, run FROM x WHERE run>0 AND run<=3600""")
def _(t):
    x = skew.neighbour(rides(t), ["line", "from_station"], ["dep", "ride_id"], skew.span("dep", 30 * clocks.DAY_S), ["dep"], "nx", following=True)
    run = F.col("nx.dep") - F.col("arr")
    return x.where((run > 0) & (run <= 3600)).select("ride_id", run.alias("run"))


@query("W13_headway_gaps", f"""
WITH {RIDES}, g AS (SELECT line, from_station, lead(dep) OVER (PARTITION BY line, from_station ORDER BY dep, ride_id)-dep AS gap FROM rides)
SELECT line, from_station, min(gap) AS min_gap, quantile_cont(gap,0.1) AS q10, quantile_cont(gap,0.5) AS med, count_if(gap<30)::BIGINT AS below30, count_if(gap<45)::BIGINT AS below45, count_if(gap<60)::BIGINT AS below60 FROM g WHERE gap IS NOT NULL GROUP BY ALL""")
def _(t):
    g = S.next_gap(rides(t), ["line", "from_station"], ["dep", "ride_id"], skew.span("dep", 30 * clocks.DAY_S), "dep", "gap").where("gap is not null")
    counts = g.groupBy("line", "from_station").agg(F.min("gap").alias("min_gap"), *[F.count_if(F.col("gap") < k).alias(f"below{k}") for k in (30, 45, 60)])
    return counts.join(Q.quantiles(g, ["line", "from_station"], "gap", 3600.0, {"q10": 0.1, "med": 0.5}), ["line", "from_station"])


@query("W14_minimum_gap_per_pair", f"""
WITH {RIDES}, x AS (SELECT from_station, ride_id, line, dep, lead(ride_id) OVER w AS n_id, lead(line) OVER w AS n_line, lead(dep) OVER w - dep AS gap FROM rides WINDOW w AS (PARTITION BY from_station ORDER BY dep, ride_id))
SELECT from_station, line AS first_line, n_line AS second_line, min(gap) AS min_gap, arg_min(ride_id,(gap,ride_id)) AS first_ride, count(*) AS n FROM x WHERE n_id IS NOT NULL GROUP BY ALL""")
def _(t):
    x = skew.neighbour(rides(t), ["from_station"], ["dep", "ride_id"], skew.span("dep", WEEK_S), ["ride_id", "line", "dep"], "nx", following=True)
    x = x.where("nx is not null").withColumn("gap", F.col("nx.dep") - F.col("dep"))
    return x.groupBy("from_station", F.col("line").alias("first_line"), F.col("nx.line").alias("second_line")).agg(
        F.min("gap").alias("min_gap"), F.min_by("ride_id", F.struct("gap", "ride_id")).alias("first_ride"), F.count(F.lit(1)).alias("n"))


@query("W15_direction_from_monotonicity", f"""
WITH c AS (SELECT l_orderkey AS trip, count(*) AS n, corr(l_linenumber, epoch_us(l_shipdate)//86400000000) AS r FROM lineitem GROUP BY 1)
SELECT trip, CASE WHEN n<3 OR r IS NULL OR isnan(r) OR abs(r)<0.30 THEN 'NONE' WHEN r>0 THEN 'UP' ELSE 'DOWN' END AS direction FROM c""")
def _(t):
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("trip")).agg(
        F.count(F.lit(1)).alias("n"), A.corr("l_linenumber", F.unix_date(F.col("l_shipdate").cast("date"))).alias("r"))
    weak = (F.col("n") < 3) | F.col("r").isNull() | (F.abs("r") < 0.30)
    return c.select("trip", F.when(weak, "NONE").when(F.col("r") > 0, "UP").otherwise("DOWN").alias("direction"))


@query("W16_offset_profile", """
WITH st AS (SELECT l_orderkey AS trip, (l_suppkey%6)::INT AS line, l_linenumber AS stop, min(epoch_us(l_shipdate)//86400000000) AS tm FROM lineitem GROUP BY 1,2,3),
 o AS (SELECT a.line, a.stop, a.trip, a.tm, a.tm-r.tm AS off FROM st a JOIN st r ON a.trip=r.trip AND a.line=r.line AND r.stop=1),
 p AS (SELECT line, stop, median(off) AS offset_med FROM o GROUP BY ALL HAVING count(*)>=2)
SELECT line, trip, median(tm-offset_med) AS intercept, count(*) AS n FROM st JOIN p USING (line, stop) GROUP BY ALL""")
def _(t):
    st = t.lineitem.groupBy(F.col("l_orderkey").alias("trip"), (F.col("l_suppkey") % 6).cast("int").alias("line"), F.col("l_linenumber").alias("stop")).agg(
        F.min(F.unix_date(F.col("l_shipdate").cast("date"))).cast("bigint").alias("tm"))
    ref = st.where("stop = 1").select("trip", "line", F.col("tm").alias("ref_tm"))
    o = st.join(ref, ["trip", "line"]).withColumn("off", F.col("tm") - F.col("ref_tm"))
    enough = o.groupBy("line", "stop").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").drop("c")
    p = Q.median(o, ["line", "stop"], "off", 30.0, "offset_med").join(enough, ["line", "stop"])
    x = st.join(p, ["line", "stop"]).withColumn("res", F.col("tm") - F.col("offset_med"))
    return Q.median(x, ["line", "trip"], "res", 30.0, "intercept").join(x.groupBy("line", "trip").agg(F.count(F.lit(1)).alias("n")), ["line", "trip"])


GAPPED = """g AS (SELECT user_id, event_id, CASE WHEN event_type IN ('error','signup') THEN NULL ELSE value END AS v, epoch_us(ts)//1000000 AS s FROM events)"""


def gapped(t):
    return t.events.select("user_id", "event_id", F.when(~F.col("event_type").isin("error", "signup"), F.col("value")).alias("v"),
                           clocks.epoch_s(F.col("ts")).alias("s"))


INTERP = f"""WITH {GAPPED}, k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN s END IGNORE NULLS) OVER b AS ap, last_value(v IGNORE NULLS) OVER b AS av,
  first_value(CASE WHEN v IS NOT NULL THEN s END IGNORE NULLS) OVER f AS bp, first_value(v IGNORE NULLS) OVER f AS bv FROM g
  WINDOW b AS (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("W17_interpolation", f"""{INTERP} SELECT event_id, round(coalesce(v, av+(bv-av)*(s-ap)/nullif(bp-ap,0), av, bv),6) AS filled FROM k""")
def _(t):
    x = S.interpolate(gapped(t), ["user_id"], "s", "v", skew.span("s", clocks.DAY_S), "filled", tie=["event_id"])
    return x.select("event_id", F.round("filled", 6).alias("filled"))


STOPS = """ev AS (SELECT l_orderkey AS trip, l_orderkey%6 AS line, l_linenumber*3 AS pos, min((l_orderkey*97)%86400 + (CASE WHEN l_orderkey%4=3 THEN -1 ELSE 1 END)*l_linenumber*3*(60+l_orderkey%6*15) + l_partkey%40)::DOUBLE AS t FROM lineitem GROUP BY 1,2,3),
 per AS (SELECT line, abs(t-pt)/(pos-pp) AS per FROM (SELECT *, lag(t) OVER w AS pt, lag(pos) OVER w AS pp FROM ev WINDOW w AS (PARTITION BY trip ORDER BY pos)) WHERE pp IS NOT NULL AND abs(t-pt)/(pos-pp) BETWEEN 30 AND 300),
 edge AS (SELECT line, coalesce(m, (SELECT median(per) FROM per), 121.0) AS per_edge FROM (SELECT DISTINCT line FROM ev) LEFT JOIN (SELECT line, median(per) AS m FROM per GROUP BY 1) USING (line))"""


def trip_stops(t):
    """Stops of trips on six lines, every fourth trip against the corridor's order."""
    sign = F.when(F.col("l_orderkey") % 4 == 3, -1).otherwise(1)
    at = F.col("l_orderkey") * 97 % 86400 + sign * F.col("l_linenumber") * 3 * (60 + F.col("l_orderkey") % 6 * 15) + F.col("l_partkey") % 40
    return t.lineitem.groupBy(F.col("l_orderkey").alias("trip"), (F.col("l_orderkey") % 6).alias("line"), (F.col("l_linenumber") * 3).cast("bigint").alias("pos")).agg(F.min(at).cast("double").alias("t"))


@query("W18_gap_completion", f"""
WITH {STOPS}, tr AS (SELECT trip, line, per_edge, count(*) AS n, median(pos::DOUBLE) AS ref, CASE WHEN arg_max(t,pos)>=arg_min(t,pos) THEN 1.0 ELSE -1.0 END::DOUBLE AS sgn FROM ev JOIN edge USING (line) GROUP BY ALL),
 ic AS (SELECT trip, median(t-sgn*(pos-ref)*per_edge) AS at_ FROM ev JOIN tr USING (trip) GROUP BY 1),
 grid AS (SELECT trip, unnest(range(0,25)) AS pos FROM tr WHERE n>=2 UNION SELECT trip, pos FROM ev),
 near AS (SELECT g.trip, g.pos, min(abs(g.pos-ev.pos)) AS d FROM grid g JOIN ev USING (trip) GROUP BY ALL)
SELECT grid.trip, grid.pos, round(coalesce(ev.t, at_+sgn*(grid.pos-ref)*per_edge),4) AS filled, CASE WHEN ev.t IS NOT NULL THEN 0 ELSE least(600, 30+25*d) END::BIGINT AS uncertainty, ev.t IS NOT NULL AS original
FROM grid JOIN tr USING (trip) JOIN ic USING (trip) JOIN near ON near.trip=grid.trip AND near.pos=grid.pos LEFT JOIN ev ON ev.trip=grid.trip AND ev.pos=grid.pos""")
def _(t):
    return S.complete_trips(trip_stops(t), "trip", "line", "pos", "t", 0, 24).withColumn("filled", F.round("filled", 4))


#: Corridors out of the nations' numbers: the plain order, the order back, and one that leaves out every node of the form 5k + 1.
VARIANTS = """vn AS (SELECT line, v AS variant, n_nationkey AS node, (1+n_nationkey%3)::DOUBLE AS len, CASE WHEN v=1 THEN 24-n_nationkey ELSE n_nationkey END AS o FROM nation, range(0,6) AS l(line), range(0,3) AS k(v) WHERE v<2 OR n_nationkey%5<>1),
 va AS (SELECT line, variant, node, row_number() OVER w - 1 AS i, sum(len) OVER w AS cum FROM vn WINDOW w AS (PARTITION BY line, variant ORDER BY o))"""


def corridor_variants(t):
    x = t.nation.select(F.col("n_nationkey").cast("bigint").alias("node"), (1 + F.col("n_nationkey") % 3).cast("double").alias("len"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("line")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("variant")).where("variant < 2 or node % 5 <> 1")
    x = x.withColumns({"o": F.when(F.col("variant") == 1, 24 - F.col("node")).otherwise(F.col("node")), "one": F.lit(1).cast("bigint"), "line": F.col("line").cast("bigint")})
    x = skew.running(x, ["line", "variant"], ["o"], None, {"i": ("sum", "one"), "cum": ("sum", "len")})
    return x.select("line", "variant", (F.col("i") - 1).alias("i"), "node", "cum")


@query("W19_observed_preserving_completion", f"""
WITH {STOPS}, {VARIANTS}, many AS (SELECT trip FROM ev GROUP BY 1 HAVING count(*)>=2),
 seen AS (SELECT ev.trip, vs.variant, ev.line, ev.pos, ev.t, va.i, va.cum FROM ev SEMI JOIN many USING (trip) JOIN (SELECT DISTINCT line, variant FROM va) vs ON vs.line=ev.line LEFT JOIN va ON va.line=ev.line AND va.variant=vs.variant AND va.node=ev.pos),
 gate AS (SELECT trip, variant FROM (SELECT *, lag(i) OVER w AS pi, lag(t) OVER w AS pt, row_number() OVER w AS rn FROM seen WINDOW w AS (PARTITION BY trip, variant ORDER BY t, pos)) GROUP BY 1,2 HAVING bool_and(i IS NOT NULL AND (rn=1 OR coalesce(pi<i AND pt<t,false)))),
 grid AS (SELECT g.trip, g.variant, va.node, va.i, va.cum, s.t FROM gate g JOIN (SELECT DISTINCT trip, line FROM ev) e USING (trip) JOIN va ON va.line=e.line AND va.variant=g.variant LEFT JOIN seen s ON s.trip=g.trip AND s.variant=g.variant AND s.i=va.i),
 k AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN cum END IGNORE NULLS) OVER b AS lc, last_value(t IGNORE NULLS) OVER b AS lt, first_value(CASE WHEN t IS NOT NULL THEN cum END IGNORE NULLS) OVER f AS rc, first_value(t IGNORE NULLS) OVER f AS rt FROM grid
  WINDOW b AS (PARTITION BY trip, variant ORDER BY i ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY trip, variant ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT k.trip, variant::INT AS variant, node AS pos, round(coalesce(t, lt+CASE WHEN rc-lc<=1e-9 THEN 0.5 ELSE (cum-lc)/(rc-lc) END*(rt-lt), lt+(cum-lc)*per_edge, rt-(rc-cum)*per_edge),4) AS filled,
 CASE WHEN t IS NOT NULL THEN 15.0 ELSE least(600.0, greatest(15.0, 30+25*least(coalesce(cum-lc,1e9), coalesce(rc-cum,1e9)))) END::DOUBLE AS uncertainty,
 CASE WHEN t IS NOT NULL THEN 'ORIGINAL' WHEN lt IS NOT NULL AND rt IS NOT NULL THEN 'BETWEEN_OBSERVED_ANCHORS' WHEN lt IS NOT NULL THEN 'EXTRAPOLATED_AFTER_LAST_OBSERVED' ELSE 'EXTRAPOLATED_BEFORE_FIRST_OBSERVED' END AS role
FROM k JOIN (SELECT DISTINCT trip, line FROM ev) e USING (trip) JOIN edge USING (line)""")
def _(t):
    x = S.complete_variants(trip_stops(t), corridor_variants(t), "trip", "line", "pos", "t", 15.0)
    return x.withColumn("filled", F.round("filled", 4))


@query("W20_monotone_repair", """
WITH ev AS (SELECT l_orderkey AS root, l_linenumber AS seq, min((l_orderkey*97)%86400 + l_linenumber*40 + l_partkey%20)::DOUBLE AS base, min(l_discount*1000-50) AS old, min(CASE WHEN l_returnflag<>'N' THEN l_tax*6000-240 END) AS direct, min(l_quantity*10) AS w FROM lineitem GROUP BY 1,2),
 k AS (SELECT *, last_value(CASE WHEN direct IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS ap, last_value(direct IGNORE NULLS) OVER b AS av, first_value(CASE WHEN direct IS NOT NULL THEN seq END IGNORE NULLS) OVER f AS bp, first_value(direct IGNORE NULLS) OVER f AS bv,
  max(CASE WHEN direct IS NOT NULL THEN w END) OVER (PARTITION BY root) AS wm FROM ev WINDOW b AS (PARTITION BY root ORDER BY seq ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY root ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 v AS (SELECT *, greatest(-180.0, least(180.0, wm/(wm+300.0)*coalesce(direct, av+(bv-av)*(seq-ap)/nullif(bp-ap,0), av, bv) + (1-wm/(wm+300.0))*old)) AS v FROM k),
 f AS (SELECT *, max(base+v-seq*1.0) OVER (PARTITION BY root ORDER BY seq ROWS UNBOUNDED PRECEDING)+seq*1.0 AS fixed FROM v)
SELECT root, seq, round(CASE WHEN wm IS NULL THEN old ELSE greatest(-180.0, least(180.0, fixed-base)) END,6) AS offset_s, wm IS NOT NULL AND fixed>base+v+1e-9 AS repaired FROM f""")
def _(t):
    ev = t.lineitem.groupBy(F.col("l_orderkey").alias("root"), F.col("l_linenumber").alias("seq")).agg(
        F.min(F.col("l_orderkey") * 97 % 86400 + F.col("l_linenumber") * 40 + F.col("l_partkey") % 20).cast("double").alias("base"), F.min(F.col("l_discount") * 1000 - 50).alias("old"),
        F.min(F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 6000 - 240)).alias("direct"), F.min(F.col("l_quantity") * 10).alias("w"))
    x = S.repair_offsets(ev, "root", "seq", "base", "old", "direct", "w")
    return x.select("root", "seq", F.round("offset", 6).alias("offset_s"), "repaired")


@query("W21_min_rank", """
WITH s AS (SELECT l_suppkey, l_returnflag, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY q DESC) AS rnk FROM s""")
def _(t):
    s = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    return Q.ranks(s, ["l_returnflag"], "q", 500.0).select("l_suppkey", "l_returnflag", F.col("rank_desc").alias("rnk"))


@query("W22_mid_rank_unit", """
WITH r AS (SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value)-1 + (count(*) OVER (PARTITION BY event_type, value)-1)/2.0::DOUBLE AS m, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, round(CASE WHEN n=1 THEN 0.0 ELSE m/(n-1) END,6) AS rank01 FROM r""")
def _(t):
    r = Q.ranks(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", 5.0)
    return r.select("event_id", F.round(F.when(F.col("n") == 1, 0.0).otherwise((F.col("rank_avg") - 1) / (F.col("n") - 1)), 6).alias("rank01"))


@query("W23_min_max_scale", """
SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value-min(value) OVER w)/(max(value) OVER w-min(value) OVER w) ELSE 0.0 END,6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)""")
def _(t):
    x = skew.attach(t.events.select("event_id", "user_id", "value"), ["user_id"], [F.min("value").alias("lo"), F.max("value").alias("hi")])
    return x.select("event_id", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0), 6).alias("scaled"))


@query("W24_suffix_minimum", f"""
WITH {RIDES} SELECT ride_id, min(arr) OVER (PARTITION BY from_station, to_station ORDER BY dep, ride_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best_arr FROM rides""")
def _(t):
    return skew.running(rides(t), ["from_station", "to_station"], ["dep", "ride_id"], skew.span("dep", 30 * clocks.DAY_S),
                        {"best_arr": ("min", "arr")}, suffix=True).select("ride_id", "best_arr")


@query("W25_missing_parts", """
WITH p AS (SELECT DISTINCT l_orderkey AS i FROM lineitem) SELECT m AS missing FROM (SELECT unnest(range((SELECT max(i) FROM p)+1)) AS m) WHERE m NOT IN (SELECT i FROM p)""")
def _(t):
    from ledgerline.operators.reconcile import missing_indices
    return missing_indices(t.lineitem, "l_orderkey")
