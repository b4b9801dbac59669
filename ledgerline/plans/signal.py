"""Time-series queries on tap counts by station and five-minute bin of the service day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import clocks
from ledgerline.operators import aggregates as A
from ledgerline.operators import quantiles as Q
from ledgerline.operators import signal as G
from ledgerline.operators import topk as K
from ledgerline.plans.views import RIDES, TAPS, rides, taps
from ledgerline.registry import query, staged

BINS, BIN_S = 288, 300

CELLS = f"""{TAPS}, cells AS (SELECT station, (((us//1000000-14400)%86400)//300)::BIGINT AS bin, count(*) AS x FROM taps GROUP BY ALL)"""
GRID = f"""{CELLS}, grid AS (SELECT s.station, b.bin, coalesce(x,0) AS x FROM (SELECT DISTINCT station FROM cells) s CROSS JOIN (SELECT unnest(range(288)) AS bin) b LEFT JOIN cells USING (station, bin))"""


def ma(w: int) -> str:
    lo, hi = G.frame(w)
    return f"(sum(x) OVER (PARTITION BY station ORDER BY bin ROWS BETWEEN {-lo} PRECEDING AND {hi} FOLLOWING)/{float(w)}::DOUBLE)"


SCORED = f"""{GRID}, m AS (SELECT *, {ma(3)} AS short_avg, {ma(20)} AS background FROM grid), scored AS (SELECT *, short_avg-background AS residual, (short_avg-background)/sqrt(greatest(background,0.25::DOUBLE)) AS score FROM m)"""
PULSES = f"""{SCORED}, th AS (SELECT station, greatest(quantile_cont(score,0.9),0.5::DOUBLE) AS threshold FROM scored GROUP BY 1),
 nb AS (SELECT *, lag(score,1,score) OVER w AS l, lead(score,1,score) OVER w AS r FROM scored WINDOW w AS (PARTITION BY station ORDER BY bin)),
 cand AS (SELECT nb.*, threshold FROM nb JOIN th USING (station) WHERE score>=l AND score>=r AND residual>0 AND score>=threshold AND bin>=10 AND bin<278),
 keep AS (SELECT station, unnest(list_reduce(list([bin] ORDER BY score DESC, bin), lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: abs(z-y[1])<4))=0 THEN acc||y ELSE acc END)) AS bin FROM cand GROUP BY 1),
 pulses AS (SELECT cand.* FROM cand JOIN keep USING (station, bin))"""


def binned(t):
    return taps(t).select("station", F.floor(F.pmod(F.floor(F.col("us") / 1_000_000) - clocks.SERVICE_DAY_START_S, F.lit(clocks.DAY_S)) / BIN_S).alias("bin"))


@staged
def grid(t):
    return G.dense_grid(binned(t), ["station"], "bin", BINS)


@staged
def scored(t):
    return G.pulse_scores(grid(t), ["station"], "bin", "x", 3, 20)


@staged
def pulses(t):
    return G.pulses(scored(t), ["station"], "bin", 0.90, 0.5, 4, guard=10, bins=BINS)


@query("G01_count_grid", f"WITH {CELLS} SELECT station, bin, x FROM cells")
def _(t):
    return G.count_grid(binned(t), ["station"], "bin")


@query("G02_moving_average", f"WITH {GRID} SELECT station, bin, round({ma(3)},9) AS m3, round({ma(20)},9) AS m20 FROM grid")
def _(t):
    m = G.moving_averages(grid(t), ["station"], "bin", "x", {"m3": 3, "m20": 20})
    return m.select("station", "bin", F.round("m3", 9).alias("m3"), F.round("m20", 9).alias("m20"))


@query("G03_highpass", f"WITH {GRID} SELECT station, bin, round({ma(3)}-{ma(60)},9) AS hp FROM grid")
def _(t):
    return G.highpass(grid(t), ["station"], "bin", "x", 3, 60, "hp").select("station", "bin", F.round("hp", 9).alias("hp"))


@query("G04_pulse_detector", f"WITH {PULSES} SELECT station, bin, round(score,6) AS score, round(threshold,6) AS threshold FROM pulses")
def _(t):
    return pulses(t).select("station", "bin", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"))


@query("G05_pulse_extent", f"""
WITH {PULSES}, ext AS (SELECT p.station, p.bin AS centre, coalesce((SELECT max(s.bin)+1 FROM scored s WHERE s.station=p.station AND s.bin<p.bin AND s.bin>=p.bin-6 AND s.residual<=0), greatest(0,p.bin-6)) AS lo,
  coalesce((SELECT min(s.bin)-1 FROM scored s WHERE s.station=p.station AND s.bin>p.bin AND s.bin<=p.bin+6 AND s.residual<=0), least(287,p.bin+6)) AS hi FROM pulses p)
SELECT e.station, centre, lo, hi, sum(x)::BIGINT AS mass, round(sum(background),6) AS background_mass, round(greatest(0,sum(x)-sum(background)),6) AS excess FROM ext e JOIN scored s ON s.station=e.station AND s.bin BETWEEN lo AND hi GROUP BY ALL""")
def _(t):
    e = G.pulse_extent(pulses(t), scored(t), ["station"], "bin", "x", 6)
    return e.select("station", "centre", "lo", "hi", "mass", F.round("background_mass", 6).alias("background_mass"), F.round("excess", 6).alias("excess"))


LAGS = f"""{GRID}, hp AS (SELECT station, bin, {ma(3)}-{ma(60)} AS h FROM grid), edges AS (SELECT DISTINCT station AS u, (station+1)%23 AS v FROM grid),
 lagged AS (SELECT u, v, lag, count(*) AS n, corr(a.h,b.h) AS corr FROM edges JOIN hp a ON a.station=u CROSS JOIN (SELECT unnest(range(1,13)) AS lag) JOIN hp b ON b.station=v AND b.bin=a.bin+lag GROUP BY ALL)"""


def lagged(t):
    hp = G.highpass(grid(t), ["station"], "bin", "x", 3, 60, "h")
    edges = binned(t).select(F.col("station").alias("u"), ((F.col("station") + 1) % 23).alias("v")).distinct()
    return edges, G.lag_scores(hp, edges, "station", "bin", "h", F.sequence(F.lit(1), F.lit(12)))


@query("G06_lagged_correlation", f"WITH {LAGS} SELECT u, v, lag, n, round(corr,6) AS corr FROM lagged WHERE n>=60")
def _(t):
    return lagged(t)[1].select("u", "v", F.col("lag").cast("bigint").alias("lag"), "n", F.round("corr", 6).alias("corr"))


@query("G07_best_lag", f"WITH {LAGS} SELECT u, v, arg_min(lag,(-round(corr,9),abs(lag-6),lag)) AS lag, round(arg_min(corr,(-round(corr,9),abs(lag-6),lag)),6) AS corr FROM lagged GROUP BY ALL")
def _(t):
    b = G.best_lag(lagged(t)[1], ["u", "v"], F.lit(6))
    return b.select("u", "v", F.col("lag").cast("bigint").alias("lag"), F.round("corr", 6).alias("corr"))


FALLBACK = f"""{LAGS}, b AS (SELECT u, v, arg_min(lag,(-round(corr,9),abs(lag-6),lag)) AS lag, max(corr) AS corr FROM lagged GROUP BY ALL), g AS (SELECT * FROM b WHERE corr>=0.12),
 el AS (SELECT e.u, e.v, coalesce(g.lag::DOUBLE,(SELECT median(lag) FROM g)) AS lag, CASE WHEN g.lag IS NULL THEN 'NETWORK_MEDIAN' ELSE 'CROSS_CORRELATION' END AS source FROM edges e LEFT JOIN g USING (u,v))"""


@staged
def edge_lags(t):
    edges, s = lagged(t)
    return G.lags_with_fallback(edges, G.best_lag(s, ["u", "v"], F.lit(6)), ["u", "v"], 0.12).select("u", "v", "lag", "source")


@query("G08_edge_lag_fallback", f"WITH {FALLBACK} SELECT * FROM el")
def _(t):
    return edge_lags(t)


OFFSETS = f"""{FALLBACK}, off AS (SELECT u//6 AS path, u AS station, sum(lag) OVER (PARTITION BY u//6 ORDER BY u) - lag AS offs FROM el)"""


def offsets(t):
    el = edge_lags(t).withColumn("path", F.floor(F.col("u") / 6))
    c = G.cumulative_offsets(el, ["path"], "u", "lag", "reach")
    return c.select("path", F.col("u").alias("station"), (F.col("reach") - F.col("lag")).alias("offs"))


@query("G09_cumulative_offsets", f"WITH {OFFSETS} SELECT path, station, offs FROM off")
def _(t):
    return offsets(t)


PROJECTED = f"""{PULSES}, el AS (SELECT station AS u, 2.0::DOUBLE + station%3 AS lag FROM (SELECT DISTINCT station FROM grid)), off AS (SELECT u//6 AS path, u AS station, sum(lag) OVER (PARTITION BY u//6 ORDER BY u) - lag AS offs FROM el),
 proj AS (SELECT path, p.station, bin, score, round(bin - offs,6) AS pos FROM pulses p JOIN off USING (station))"""


def fixed_offsets(t):
    el = binned(t).select(F.col("station").alias("u")).distinct().withColumn("lag", F.lit(2.0) + F.col("u") % 3).withColumn("path", F.floor(F.col("u") / 6))
    c = G.cumulative_offsets(el, ["path"], "u", "lag", "reach")
    return c.select("path", F.col("u").alias("station"), (F.col("reach") - F.col("lag")).alias("offs"))


def projected(t):
    return pulses(t).join(fixed_offsets(t), "station").select("path", "station", "bin", "score", F.round(F.col("bin") - F.col("offs"), 6).alias("pos"))


@query("G10_reference_projection", f"WITH {PROJECTED} SELECT path, station, bin, pos FROM proj")
def _(t):
    return projected(t).select("path", "station", "bin", "pos")


CLUSTERED = f"""{PROJECTED}, ev AS (SELECT path, pos, 1.0::DOUBLE + bin%5 AS w, station::VARCHAR||':'||bin::VARCHAR AS member FROM proj),
 fold AS (SELECT path, list_reduce(list([{{'c':pos,'w':w,'k':0::BIGINT,'m':member}}] ORDER BY pos, member), lambda acc, y: acc || [{{'c': CASE WHEN abs(y[1].c-acc[-1].c)<=1.5 THEN acc[-1].c+(y[1].c-acc[-1].c)*y[1].w/(acc[-1].w+y[1].w) ELSE y[1].c END,
   'w': CASE WHEN abs(y[1].c-acc[-1].c)<=1.5 THEN acc[-1].w+y[1].w ELSE y[1].w END, 'k': CASE WHEN abs(y[1].c-acc[-1].c)<=1.5 THEN acc[-1].k ELSE acc[-1].k+1 END, 'm': y[1].m}}]) AS l FROM ev GROUP BY 1),
 lab AS (SELECT path, u.x.k AS k, u.x.m AS member FROM fold, unnest(l) AS u(x)), clus AS (SELECT ev.*, k, split_part(ev.member,':',1)::INT AS station FROM ev JOIN lab USING (path, member)),
 csum AS (SELECT path, k, count(*) AS events, count(DISTINCT station) AS stations, sum(w) AS support, sum(pos*w)/sum(w) AS centre FROM clus GROUP BY ALL)"""


@staged
def clusters(t):
    ev = projected(t).select("path", "pos", (F.lit(1.0) + F.col("bin") % 5).alias("w"), F.concat_ws(":", F.col("station").cast("string"), F.col("bin").cast("string")).alias("member"))
    c = G.running_centre_clusters(ev, ["path"], "pos", "w", "member", 1.5, 64.0)
    return c.withColumn("station", F.split_part("member", F.lit(":"), F.lit(1)).cast("int"))


@query("G11_running_centre_clusters", f"WITH {CLUSTERED} SELECT path, events, stations, support, round(centre,6) AS centre FROM csum")
def _(t):
    c = clusters(t).groupBy("path", "island", "cluster_no").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("station").alias("stations"),
                                                               F.sum("weight").alias("support"), (F.sum(F.col("pos") * F.col("weight")) / F.sum("weight")).alias("centre"))
    return c.select("path", "events", "stations", "support", F.round("centre", 6).alias("centre"))


@query("G12_two_means_split")
def _(t):
    """Both sides of every splitting cluster; the split is tested on a small fixture."""
    c = clusters(t).withColumn("pos", F.col("pos") * 60)
    s = G.two_means_split(c, ["path", "island", "cluster_no"])
    return s.groupBy("path", "island", "cluster_no", "side").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("pos"), 6).alias("mean_pos"))


@query("G13_candidate_evidence", f"""
WITH {CLUSTERED}, dv AS (SELECT path, k, quantile_cont(abs(pos-centre),0.9) AS dev90 FROM clus JOIN csum USING (path,k) GROUP BY ALL),
 sc AS (SELECT path, stations, support, stations/6.0::DOUBLE*ln(1+support)*exp(-dev90/1.5::DOUBLE) AS evidence FROM csum JOIN dv USING (path,k))
SELECT path, stations, support, round(evidence,6) AS evidence, CASE WHEN stations<2 THEN 'LOW_SUPPORT' WHEN evidence<=0.3 THEN 'COMPLEXITY' ELSE 'RETAINED' END AS outcome FROM sc""")
def _(t):
    s = G.cluster_summary(clusters(t), ["path", "island", "cluster_no"], "station", 6, 1.5, 0.3)
    out = F.when(F.col("stations") < 2, "LOW_SUPPORT").when(F.col("gain") <= 0, "COMPLEXITY").otherwise("RETAINED")
    return s.select("path", "stations", "support", F.round("evidence", 6).alias("evidence"), out.alias("outcome"))


@query("G14_duplicate_merge", f"""
WITH {RIDES}, c AS (SELECT ride_id, from_station, line, dep, arr-dep AS w, [to_station, line+100, (ride_id%4)::INT+200] AS ev FROM rides),
 l AS (SELECT from_station, line, list_reduce(list([{{'i':ride_id,'t':dep,'e':ev}}] ORDER BY w DESC, ride_id), lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: abs(z.t-y[1].t)<=7200 AND len(list_intersect(z.e,y[1].e))/3.0::DOUBLE>=0.5))=0 THEN acc||y ELSE acc END) AS kept FROM c GROUP BY 1, 2),
 u AS (SELECT from_station, unnest(kept).i AS ride_id FROM l) SELECT from_station, ride_id FROM u""")
def _(t):
    from ledgerline.operators import joins as J
    from ledgerline.operators.graph import greedy_independent
    from ledgerline.functions.arrays import overlap_ratio
    r = rides(t).withColumn("ev", F.array(F.col("to_station"), F.col("line") + 100, (F.col("ride_id") % 4).cast("int") + 200)).withColumn("w", F.col("arr") - F.col("dep"))
    p = J.band_pairs(r, ["from_station", "line"], "dep", "ride_id", 7201, ["ev"])
    e = p.where(overlap_ratio(F.col("a_ev"), F.col("b_ev")) >= 0.5).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return greedy_independent(r.select("ride_id", "from_station", "w"), "ride_id", e, [-F.col("w"), F.col("ride_id")]).select("from_station", "ride_id")


PHASE_SRC = f"""{PULSES}, pred AS (SELECT DISTINCT station, (bin//5)*5+2 AS target FROM grid), r AS (SELECT pred.station, target, min((abs(p.bin-target), p.bin))[2]-target AS res FROM pred JOIN pulses p ON p.station=pred.station AND abs(p.bin-target)<=6 GROUP BY 1,2),
 ph AS (SELECT station, median(res) AS phase, count(*) AS n FROM r GROUP BY 1 HAVING count(*)>=3)"""


def phases(t):
    pred = grid(t).select("station", (F.floor(F.col("bin") / 5) * 5 + 2).alias("target")).distinct()
    return G.station_phase(pred, pulses(t).select("station", F.col("bin").alias("pt")), "station", "target", "pt", 6, 64.0)


@query("G15_station_phase", f"WITH {PHASE_SRC} SELECT station, round(phase-(SELECT median(phase) FROM ph),6) AS phase, n FROM ph")
def _(t):
    return phases(t).select("station", F.round("phase", 6).alias("phase"), "n")


@query("G16_trajectory_materialisation", f"""
WITH {CLUSTERED} SELECT c.path, round(centre,6) AS reference, o.station, round(round(centre,6)+offs,6) AS at FROM csum c JOIN off o USING (path)""")
def _(t):
    c = clusters(t).groupBy("path", "island", "cluster_no").agg(F.round(F.sum(F.col("pos") * F.col("weight")) / F.sum("weight"), 6).alias("reference"))
    return c.join(fixed_offsets(t), "path").select("path", "reference", "station", F.round(F.col("reference") + F.col("offs"), 6).alias("at"))


def discover(t, rounds: int = 2):
    """Project, cluster, retain, materialise, re-estimate station phases, once per round."""
    from ledgerline.session import cut_lineage
    found = cut_lineage(pulses(t).select("station", "bin", "score"))
    off = cut_lineage(fixed_offsets(t))
    phase = off.select("station", F.lit(0.0).alias("phase"))
    kept = None
    for _ in range(rounds):
        x = found.join(off, "station").join(phase, "station", "left").fillna(0.0, ["phase"])
        ev = x.select("path", F.round(F.col("bin") - F.col("offs") - F.col("phase"), 6).alias("pos"), F.col("score").alias("w"),
                      F.concat_ws(":", F.col("station").cast("string"), F.col("bin").cast("string")).alias("member"))
        c = G.running_centre_clusters(ev, ["path"], "pos", "w", "member", 1.5, 64.0).withColumn("station", F.split_part("member", F.lit(":"), F.lit(1)).cast("int"))
        kept = cut_lineage(G.cluster_summary(c, ["path", "island", "cluster_no"], "station", 6, 1.5, 0.3).where("stations >= 2 and gain > 0"))
        pred = kept.join(off, "path").select("station", (F.col("centre") + F.col("offs")).alias("target"))
        phase = cut_lineage(G.station_phase(pred, found.select("station", F.col("bin").cast("double").alias("pt")), "station", "target", "pt", 6, 64.0).select("station", "phase"))
    return kept


@query("G17_iterated_discovery")
def _(t):
    """Two rounds of discovery; rows only, its steps G04, G10, G11, G13 and G15 each have SQL."""
    return discover(t).select("path", "stations", "events", F.round("centre", 6).alias("centre"), F.round("evidence", 6).alias("evidence"))


def ladder_sql(width: int, sep: int) -> str:
    base = PULSES.replace("abs(z-y[1])<4", f"abs(z-y[1])<{sep}").replace(ma(20), ma(width))
    return f"SELECT {width} AS background_bins, station, count(*) AS pulses FROM (WITH {base} SELECT station FROM pulses) GROUP BY 2"


@query("G18_resolution_ladder", " UNION ALL ".join(ladder_sql(w, s) for w, s in ((40, 8), (20, 4), (10, 2))))
def _(t):
    g = grid(t)
    out = None
    for width, sep in ((40, 8), (20, 4), (10, 2)):
        p = G.pulses(G.pulse_scores(g, ["station"], "bin", "x", 3, width), ["station"], "bin", 0.90, 0.5, sep, guard=10, bins=BINS)
        p = p.groupBy("station").agg(F.count(F.lit(1)).alias("pulses")).withColumn("background_bins", F.lit(width))
        out = p if out is None else out.unionByName(p)
    return out


ZED = f"""{GRID}, md AS (SELECT station, median(x) AS med FROM grid GROUP BY 1), ad AS (SELECT station, med, median(abs(x-med)) AS mad, sum(x) AS mass FROM grid JOIN md USING (station) GROUP BY ALL),
 z AS (SELECT station, bin, (x-med)/greatest(1.0::DOUBLE,1.4826::DOUBLE*mad) AS z, sqrt(greatest(1.0::DOUBLE,mass)) AS w FROM grid JOIN ad USING (station))"""


@staged
def zed(t):
    g = grid(t)
    mm = Q.median_mad(g, ["station"], "x", 4.0)
    mass = g.groupBy("station").agg(F.sum("x").alias("mass"))
    z = (F.col("x") - F.col("med")) / F.greatest(F.lit(1.0), 1.4826 * F.col("mad"))
    return g.join(mm, "station").join(mass, "station").select("station", "bin", z.alias("z"), F.sqrt(F.greatest(F.lit(1.0), F.col("mass").cast("double"))).alias("w"))


@query("G19_headway_lattice", f"""
WITH {ZED}, h AS (SELECT unnest([4,6,8,12]) AS headway), s AS (SELECT (station//6)::BIGINT AS line, headway, ((bin-station%6)%headway)::BIGINT AS phase, sum(w*greatest(z,0))/sum(w) AS score FROM z, h WHERE bin-station%6>=0 GROUP BY ALL)
SELECT line, arg_min(headway,(-round(score,9),abs(headway-8),phase,headway))::BIGINT AS headway, arg_min(phase,(-round(score,9),abs(headway-8),phase,headway)) AS phase, round(max(score),6) AS score FROM s GROUP BY 1""")
def _(t):
    z = zed(t).withColumns({"line": F.floor(F.col("station") / 6), "off": (F.col("station") % 6).cast("bigint")})
    hs = t.spark.range(1).select(F.explode(F.array(*[F.lit(h).cast("bigint") for h in (4, 6, 8, 12)])).alias("headway"))
    s = G.lattice_scores(z, ["station"], "bin", "w", "off", hs, ["line"], BINS)
    return G.choose_lattice(s, ["line"], 8.0).withColumn("score", F.round("score", 6))


RIDGE = f"""{ZED}, off AS (SELECT DISTINCT station, (station//6)::BIGINT AS line, (station%6)::BIGINT AS offset_, w AS weight FROM z), den AS (SELECT line, sum(weight) AS den FROM off GROUP BY 1),
 r AS (SELECT line, bin-offset_ AS intercept, sum(weight*greatest(z,0)) AS num FROM z JOIN off USING (station) GROUP BY ALL), sc AS (SELECT line, intercept, num/den AS score FROM r JOIN den USING (line)),
 pos AS (SELECT line, list_sort(list(score)) AS v FROM sc WHERE score>0 GROUP BY 1), th AS (SELECT line, v[1+round_even((len(v)-1)*0.9::DOUBLE,0)::BIGINT] AS threshold FROM pos),
 keep AS (SELECT line, unnest(list_reduce(list([intercept] ORDER BY round(score,9) DESC, intercept), lambda acc, y: CASE WHEN len(list_filter(acc, lambda q: abs(q-y[1])<5))=0 THEN acc||y ELSE acc END)) AS intercept FROM sc JOIN th USING (line) WHERE round(score,9)>=round(threshold,9) GROUP BY 1)"""


@query("G20_ridge_scan", f"WITH {RIDGE} SELECT line, intercept, round(score,6) AS score FROM keep JOIN sc USING (line, intercept)")
def _(t):
    z = zed(t)
    off = z.select("station", F.floor(F.col("station") / 6).alias("line"), (F.col("station") % 6).cast("bigint").alias("offset"), F.col("w").alias("weight")).distinct()
    s = G.ridge_scores(z.select("station", "bin", "z"), off, "station", "bin", ["line"]).withColumn("r", F.round("score", 9))
    th = Q.quantiles(s.where("score > 0"), ["line"], "r", 0.25, {"threshold": 0.9}, kind="nearest")
    c = s.join(th, "line").where("r >= threshold")
    return K.suppress(c, ["line"], "intercept", [-F.col("r"), F.col("intercept")], 5, 4096).select("line", "intercept", F.round("score", 6).alias("score"))


@query("G21_upstream_completion", f"""
WITH {PULSES}, a AS (SELECT 'r'||bin::VARCHAR AS root, bin*300.0::DOUBLE AS t0 FROM pulses WHERE station=3), q AS (SELECT station, bin*300.0::DOUBLE AS pt, -score AS neg FROM pulses),
 s1 AS (SELECT root, t0, (SELECT min((abs(pt-(t0-600)),neg,pt)) FROM q WHERE station=2 AND pt<=t0-30 AND abs(pt-(t0-600))<=900 AND t0-600>=0) AS h FROM a), p1 AS (SELECT root, t0, h IS NOT NULL AS o1, CASE WHEN h IS NULL THEN t0-600 ELSE h[3] END AS t1 FROM s1),
 s2 AS (SELECT *, (SELECT min((abs(pt-(t1-900)),neg,pt)) FROM q WHERE station=1 AND pt<=t1-30 AND abs(pt-(t1-900))<=900 AND t1-900>=0) AS h FROM p1), p2 AS (SELECT *, h IS NOT NULL AS o2, CASE WHEN h IS NULL THEN t1-900 ELSE h[3] END AS t2 FROM s2)
SELECT root, 0 AS step, 3 AS station, t0 AS t, true AS observed, 0.0::DOUBLE AS sd FROM p2 UNION ALL SELECT root, 1, 2, t1, o1, CASE WHEN o1 THEN 20.0 ELSE 60.0 END FROM p2
UNION ALL SELECT root, 2, 1, t2, o2, CASE WHEN o2 THEN 20.0 ELSE round(greatest(60.0,sqrt(CASE WHEN o1 THEN 2025.0 ELSE 4050.0 END)),6) END FROM p2""")
def _(t):
    p = pulses(t).select("station", (F.col("bin") * 300.0).alias("s"), "score")
    anchors = p.where("station = 3").select(F.concat(F.lit("r"), F.floor(F.col("s") / 300).cast("string")).alias("root"), "s")
    c = G.complete_upstream(anchors, p, [(2, 3, 600.0), (1, 2, 900.0)], "station", "s", "score", 900.0, 30.0, 3600.0)
    return c.withColumn("sd", F.round("sd", 6))


@query("G22_progression_prior", """
WITH c AS (SELECT l_orderkey AS obs, (l_suppkey%6)::INT AS line, l_linenumber AS serial, l_partkey*10 AS f, l_partkey*10+(l_suppkey%40) AS l FROM lineitem), u AS (SELECT obs, line, serial, min(f) AS f, min(l) AS l FROM c GROUP BY 1,2,3 HAVING count(*)=1),
 v AS (SELECT a.line, a.serial, (abs(b.f-a.f)+abs(b.l-a.l))/2 AS v FROM u a JOIN u b ON a.obs=b.obs AND a.line=b.line AND b.serial=a.serial+1 WHERE abs(abs(b.f-a.f)-abs(b.l-a.l))<=30), w AS (SELECT * FROM v WHERE v>0 AND v<=6000),
 o AS (SELECT line, serial, count(*) AS n, median(v) AS med, list_sort(list(v)) AS s FROM w GROUP BY 1,2)
SELECT line, serial, n, med, s[1+floor((n-1)*0.1::DOUBLE)::BIGINT]::DOUBLE AS p10, s[1+floor((n-1)*0.9::DOUBLE)::BIGINT]::DOUBLE AS p90 FROM o""")
def _(t):
    c = t.lineitem.select(F.col("l_orderkey").alias("obs"), (F.col("l_suppkey") % 6).cast("int").alias("line"), F.col("l_linenumber").alias("serial"),
                          (F.col("l_partkey") * 10).alias("f"), (F.col("l_partkey") * 10 + F.col("l_suppkey") % 40).alias("l"))
    return G.progression_prior(c.withColumnsRenamed({"f": "first_s", "l": "last_s"}), "line", "serial", "first_s", "last_s", "obs", 30, 6000)


RUNS = f"""{RIDES}, runs AS (SELECT line, from_station, to_station, arr-dep AS run FROM rides)"""


@query("G23_runtime_priors", f"""
WITH {RUNS}, o AS (SELECT line, from_station, to_station, count(*) AS n, list_sort(list(run)) AS s FROM runs GROUP BY ALL)
SELECT line, from_station, to_station, n, s[1+round_even((n-1)*0.5::DOUBLE,0)::BIGINT] AS med, s[1+round_even((n-1)*0.1::DOUBLE,0)::BIGINT] AS p10, s[1+round_even((n-1)*0.9::DOUBLE,0)::BIGINT] AS p90 FROM o""")
def _(t):
    r = rides(t).withColumn("run", F.col("arr") - F.col("dep"))
    k = ["line", "from_station", "to_station"]
    return r.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).join(Q.quantiles(r, k, "run", 600.0, {"med": 0.5, "p10": 0.1, "p90": 0.9}, kind="nearest"), k)


@query("G24_prior_fallbacks", f"""
WITH {RUNS}, want AS (SELECT DISTINCT line, from_station, to_station FROM runs), src AS (SELECT * FROM runs), d AS (SELECT line, from_station, to_station, median(run) AS run FROM src GROUP BY ALL HAVING count(*)>=34),
 o AS (SELECT line, to_station AS from_station, from_station AS to_station, run FROM d), l AS (SELECT line, median(run) AS run FROM src GROUP BY 1 HAVING median(run)>=1620), g AS (SELECT median(run) AS run FROM src)
SELECT w.*, coalesce(d.run,o.run,l.run,(SELECT run FROM g)) AS prior, CASE WHEN d.run IS NOT NULL THEN 'DIRECT' WHEN o.run IS NOT NULL THEN 'OPPOSITE' WHEN l.run IS NOT NULL THEN 'LINE' ELSE 'GLOBAL' END AS source
FROM want w LEFT JOIN d USING (line,from_station,to_station) LEFT JOIN o USING (line,from_station,to_station) LEFT JOIN l USING (line)""")
def _(t):
    r = rides(t).select("line", "from_station", "to_station", (F.col("arr") - F.col("dep")).alias("run"))
    k = ["line", "from_station", "to_station"]
    src = r
    enough = src.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where("n >= 34").drop("n")
    d = Q.median(src, k, "run", 600.0, "prior_s").join(enough, k)
    o = d.select("line", F.col("to_station").alias("from_station"), F.col("from_station").alias("to_station"), "prior_s")
    line = Q.median(src, ["line"], "run", 600.0, "prior_s").where("prior_s >= 1620")
    return G.with_fallbacks(r.select(*k).distinct(), [("DIRECT", d, k), ("OPPOSITE", o, k), ("LINE", line, ["line"]), ("GLOBAL", Q.median(src, [], "run", 600.0, "prior_s"), [])], "prior_s", "prior", "source")
