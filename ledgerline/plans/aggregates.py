"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import clocks
from ledgerline.operators import aggregates as A
from ledgerline.operators import quantiles as Q
from ledgerline.plans.views import OD, RIDERS, TAPS, od, riders, taps
from ledgerline.registry import query
from ledgerline.session import cut_lineage


@query("A01_group_sum", f"WITH {OD} SELECT slot, origin, destination, sum(flow)::BIGINT AS flow FROM od GROUP BY ALL")
def _(t):
    return od(t).groupBy("slot", "origin", "destination").agg(F.sum("flow").alias("flow"))


@query("A02_exact_decimal_sum", """
SELECT user_id, event_type, sum(value::DECIMAL(28,6))::DECIMAL(38,6) AS amount,
  CASE WHEN contains(sum(value::DECIMAL(28,6))::VARCHAR,'.') THEN regexp_replace(sum(value::DECIMAL(28,6))::VARCHAR,'\\.?0+$','')
  ELSE sum(value::DECIMAL(28,6))::VARCHAR END AS amount_text FROM events GROUP BY ALL""")
def _(t):
    from ledgerline.functions.text import trim_decimal
    return t.events.groupBy("user_id", "event_type").agg(A.decimal_sum("value").alias("amount")).withColumn(
        "amount_text", trim_decimal(F.col("amount")))


@query("A03_multi_aggregate", """
SELECT l_suppkey, round(avg(l_quantity),6) AS mean_qty, count(*) AS n, count(DISTINCT l_partkey) AS parts,
  count_if(l_returnflag='R')::BIGINT AS returned, count_if(l_discount>0.05)::BIGINT AS discounted FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.avg("l_quantity"), 6).alias("mean_qty"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("A04_exact_second_cohorts", """
WITH c AS (SELECT o_custkey%25 AS origin, o_orderstatus AS line, o_orderpriority AS dest, o_orderdate AS entry, count(*) AS passenger_mass FROM orders GROUP BY ALL)
SELECT *, (SELECT count(*)::DOUBLE/sum(passenger_mass) FROM c) AS compression FROM c""")
def _(t):
    c = A.cohorts(t.orders.select((F.col("o_custkey") % 25).alias("origin"), F.col("o_orderstatus").alias("line"),
                                  F.col("o_orderpriority").alias("dest"), F.col("o_orderdate").alias("entry")),
                  ["origin", "line", "dest", "entry"])
    ratio = c.agg(F.count(F.lit(1)).cast("double") / F.sum("passenger_mass"))
    return c.withColumn("compression", ratio.scalar())


@query("A05_zero_filled_bins", f"""
WITH {TAPS}, h AS (SELECT ((us//1000000)%86400)//900 AS bin, count(*) AS n, count_if(status=1) AS entries, count_if(status=0) AS exits FROM taps GROUP BY 1)
SELECT r.bin, coalesce(n,0)::BIGINT AS n, coalesce(entries,0)::BIGINT AS entries, coalesce(exits,0)::BIGINT AS exits FROM (SELECT unnest(range(96)) AS bin) r LEFT JOIN h USING (bin)""")
def _(t):
    x = taps(t).withColumn("bin", F.floor(F.floor(F.col("us") / 1_000_000) % clocks.DAY_S / 900))
    return A.zero_filled(x, "bin", 96, {"n": F.count(F.lit(1)), "entries": F.count_if(F.col("status") == 1),
                                        "exits": F.count_if(F.col("status") == 0)})


@query("A06_bin_folding", f"""
WITH {OD} SELECT day, CASE WHEN slot<24 THEN 0 WHEN slot<42 THEN 1 WHEN slot<60 THEN 2 WHEN slot<78 THEN 3 WHEN slot<90 THEN 4 ELSE 5 END AS period,
 origin, destination, sum(flow)::BIGINT AS flow, count(*) AS slots FROM od GROUP BY ALL""")
def _(t):
    return od(t).groupBy("day", clocks.slot_period(F.col("slot")).alias("period"), "origin", "destination").agg(
        F.sum("flow").alias("flow"), F.count(F.lit(1)).alias("slots"))


@query("A07_dense_grid", f"""
WITH {OD}, p AS (SELECT origin, destination, slot, sum(flow)::BIGINT AS flow FROM od GROUP BY ALL),
 k AS (SELECT DISTINCT origin, destination FROM p), g AS (SELECT k.*, unnest(range(102))::INT AS slot FROM k)
SELECT g.origin, g.destination, g.slot, coalesce(flow,0)::BIGINT AS flow FROM g LEFT JOIN p USING (origin,destination,slot)""")
def _(t):
    cells = od(t).groupBy("origin", "destination", "slot").agg(F.sum("flow").alias("flow"))
    return A.densify(cells, ["origin", "destination"], "slot", 0, 101, ["flow"])


@query("A08_marginals", f"""
WITH {OD} SELECT 'origin' AS side, slot, origin AS station, sum(flow)::BIGINT AS flow FROM od GROUP BY ALL
UNION ALL SELECT 'destination', slot, destination, sum(flow)::BIGINT FROM od GROUP BY ALL""")
def _(t):
    ends = od(t).select("slot", "flow", F.explode(F.array(
        F.struct(F.lit("origin").alias("side"), F.col("origin").alias("station")),
        F.struct(F.lit("destination").alias("side"), F.col("destination").alias("station")))).alias("e"))
    return ends.groupBy("e.side", "slot", "e.station").agg(F.sum("flow").alias("flow"))


@query("A09_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*)>1""")
def _(t):
    from ledgerline.operators.contracts import duplicate_keys
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("A10_collision_audit", """
WITH k AS (SELECT l_suppkey, l_shipdate, count(*) AS n, count(DISTINCT l_returnflag) AS labels FROM lineitem GROUP BY 1,2)
SELECT count_if(n>1)::BIGINT AS collision_groups, sum(n)::BIGINT AS "rows", sum(CASE WHEN n>1 THEN n ELSE 0 END)::BIGINT AS colliding_rows,
 sum(n-1)::BIGINT AS rows_removed_by_dedup, count_if(labels>1)::BIGINT AS groups_over_labels FROM k""")
def _(t):
    return A.collision_audit(t.lineitem, ["l_suppkey", "l_shipdate"], "l_returnflag")


@query("A11_group_range_stats", """
WITH k AS (SELECT l_suppkey, l_shipdate, max(l_extendedprice)-min(l_extendedprice) AS spread FROM lineitem GROUP BY 1,2 HAVING count(*)>1)
SELECT count(*) AS n, round(quantile_cont(spread,0.5),6) AS median_range, round(quantile_cont(spread,0.9),6) AS p90_range FROM k""")
def _(t):
    k = (t.lineitem.groupBy("l_suppkey", "l_shipdate")
         .agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("spread"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    q = Q.quantiles(k, [], "spread", 500.0, {"median_range": 0.5, "p90_range": 0.9})
    return q.select(k.agg(F.count(F.lit(1))).scalar().alias("n"), *[F.round(c, 6).alias(c) for c in q.columns])


@query("A12_linear_quantile", """
SELECT l_suppkey, round(quantile_cont(l_extendedprice,0.1),6) AS p10, round(quantile_cont(l_extendedprice,0.5),6) AS p50,
 round(quantile_cont(l_extendedprice,0.9),6) AS p90 FROM lineitem GROUP BY 1""")
def _(t):
    q = Q.quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", 1000.0, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


def rank_sql(expr):
    return f"""WITH l AS (SELECT user_id, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, v[1+{expr.format(p=0.1)}] AS p10, v[1+{expr.format(p=0.5)}] AS p50, v[1+{expr.format(p=0.9)}] AS p90 FROM l"""


def ranked(t, kind):
    return Q.quantiles(t.events, ["user_id"], "value", 5.0, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, kind=kind)


@query("A13_nearest_rank_quantile", rank_sql("round_even((n-1)*{p}::DOUBLE,0)::BIGINT"))
def _(t):
    return ranked(t, "nearest")


@query("A14_floor_rank_quantile", rank_sql("floor((n-1)*{p}::DOUBLE)::BIGINT"))
def _(t):
    return ranked(t, "floor")


@query("A15_weighted_quantile", """
WITH v AS (SELECT l_suppkey, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1,2),
 c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY x) AS upto, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM v)
SELECT l_suppkey, min(x) FILTER (upto >= total*0.05::DOUBLE) AS q05, min(x) FILTER (upto >= total*0.5::DOUBLE) AS q50, min(x) FILTER (upto >= total*0.95::DOUBLE) AS q95 FROM c GROUP BY 1""")
def _(t):
    return Q.quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", 1000.0, {"q05": 0.05, "q50": 0.5, "q95": 0.95},
                       kind="weighted", weight="l_quantity")


@query("A16_robust_z", """
WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY 1),
 d AS (SELECT user_id, med, median(abs(value-med)) AS mad FROM events JOIN m USING (user_id) GROUP BY 1,2)
SELECT event_id, round((value-med)/greatest(1.0::DOUBLE,1.4826::DOUBLE*mad),6) AS z FROM events JOIN d USING (user_id)""")
def _(t):
    e = t.events.select("event_id", "user_id", "value")
    mm = Q.median_mad(e, ["user_id"], "value", 5.0)
    scale = F.greatest(F.lit(1.0), 1.4826 * F.col("mad"))
    return e.join(mm, "user_id").select("event_id", F.round((F.col("value") - F.col("med")) / scale, 6).alias("z"))


@query("A17_pearson", """
SELECT l_suppkey, round(CASE WHEN count(*)>=3 AND var_pop(l_quantity)>0 AND var_pop(l_extendedprice)>0 THEN corr(l_quantity,l_extendedprice) ELSE 0.0 END,6) AS r FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(A.pearson("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("A18_spearman", """
WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity)-1)/2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice)-1)/2.0::DOUBLE AS b FROM lineitem)
SELECT l_suppkey, round(corr(a,b),6) AS rho FROM r GROUP BY 1""")
def _(t):
    x = t.lineitem.select("l_suppkey", "l_quantity", "l_extendedprice")
    return A.spearman(x, ["l_suppkey"], "l_quantity", "l_extendedprice", 5.0, 1000.0, "rho").withColumn("rho", F.round("rho", 6))


@query("A19_weighted_moments", """
WITH m AS (SELECT l_suppkey, sum(l_tax*l_quantity)/sum(l_quantity) AS mean, sum(l_tax*l_tax*l_quantity)/sum(l_quantity) AS m2 FROM lineitem GROUP BY 1),
 p AS (SELECT l_suppkey, l_quantity/sum(l_quantity) OVER (PARTITION BY l_suppkey) AS p FROM lineitem),
 e AS (SELECT l_suppkey, -sum(p*ln(p)) AS entropy FROM p GROUP BY 1)
SELECT l_suppkey, round(mean,6) AS mean, round(m2-mean*mean,6) AS var, round(entropy,6) AS entropy FROM m JOIN e USING (l_suppkey)""")
def _(t):
    li = t.lineitem
    m = li.groupBy("l_suppkey").agg(F.round(A.weighted_mean("l_tax", "l_quantity"), 6).alias("mean"),
                                    F.round(A.weighted_variance("l_tax", "l_quantity"), 6).alias("var"))
    e = A.entropy(li, ["l_suppkey"], "l_quantity", "entropy")
    return m.join(e, "l_suppkey").withColumn("entropy", F.round("entropy", 6))


@query("A20_mode_with_fallback", """
WITH train AS (SELECT CASE WHEN p_size%7=0 THEN NULL ELSE p_brand END AS g, p_size FROM part WHERE p_retailprice<1000 AND p_brand<>'Brand#4'),
 n AS (SELECT g, p_size, count(*) AS c FROM train GROUP BY ALL), per AS (SELECT g, arg_min(p_size, (-c, p_size)) AS mode FROM n GROUP BY 1),
 tot AS (SELECT arg_min(p_size, (-c,p_size)) AS mode FROM (SELECT p_size, count(*) AS c FROM train GROUP BY 1))
SELECT p_partkey, coalesce(per.mode, (SELECT mode FROM tot)) AS mode FROM (SELECT p_partkey, CASE WHEN p_size%7=0 THEN NULL ELSE p_brand END AS g FROM part) x LEFT JOIN per ON x.g IS NOT DISTINCT FROM per.g""")
def _(t):
    p = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("g"))
    train = p.where((F.col("p_retailprice") < 1000) & (F.col("p_brand") != "Brand#4"))
    return A.mode_with_fallback(train, p.select("p_partkey", "g"), "g", "p_size", "mode").select("p_partkey", "mode")


@query("A21_balanced_accuracy", """
WITH p AS (SELECT l_returnflag AS truth, CASE WHEN l_linestatus='F' AND l_discount<0.05 THEN 'A' WHEN l_linestatus='F' THEN 'R' ELSE 'N' END AS pred FROM lineitem),
 c AS (SELECT truth, avg((truth=pred)::INT::DOUBLE) AS recall FROM p GROUP BY 1)
SELECT round(avg(recall),6) AS balanced_accuracy, round((SELECT avg((truth=pred)::INT::DOUBLE) FROM p),6) AS raw_accuracy FROM c""")
def _(t):
    f = F.col("l_linestatus") == "F"
    p = t.lineitem.select(F.col("l_returnflag").alias("truth"), F.when(f & (F.col("l_discount") < 0.05), "A").when(f, "R").otherwise("N").alias("pred"))
    r = A.balanced_accuracy(p, "truth", "pred")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("A22_nmae", """
SELECT l_suppkey, round(sum(abs(l_quantity*1500-l_extendedprice))/sum(abs(l_extendedprice)),6) AS nmae FROM lineitem GROUP BY 1""")
def _(t):
    x = t.lineitem.select("l_suppkey", (F.col("l_quantity") * 1500).alias("p"), "l_extendedprice")
    return x.groupBy("l_suppkey").agg(F.round(A.nmae("p", "l_extendedprice"), 6).alias("nmae"))


@query("A23_wasserstein", """
WITH c AS (SELECT l_quantity AS x, sum(l_extendedprice) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1),
 r AS (SELECT x, sum(a) OVER (ORDER BY x)/sum(a) OVER () AS ca, sum(b) OVER (ORDER BY x)/sum(b) OVER () AS cb, lead(x) OVER (ORDER BY x) AS nx FROM c)
SELECT round(sum(abs(ca-cb)*(nx-x)),6) AS wasserstein FROM r""")
def _(t):
    r = A.wasserstein(t.lineitem, "l_quantity", "l_extendedprice", "l_tax", 5.0)
    return r.select(F.round("wasserstein", 6).alias("wasserstein"))


@query("A24_total_variation", """
WITH a AS (SELECT l_suppkey, l_quantity AS q, count(*) AS m FROM lineitem WHERE l_returnflag='A' GROUP BY 1,2), b AS (SELECT l_suppkey, l_quantity AS q, count(*) AS m FROM lineitem WHERE l_returnflag='R' GROUP BY 1,2),
 pa AS (SELECT l_suppkey,q,m/sum(m) OVER (PARTITION BY l_suppkey) AS p FROM a), pb AS (SELECT l_suppkey,q,m/sum(m) OVER (PARTITION BY l_suppkey) AS p FROM b)
SELECT l_suppkey, round(sum(abs(coalesce(pa.p,0)-coalesce(pb.p,0)))/2,6) AS tv FROM pa FULL JOIN pb USING (l_suppkey,q) GROUP BY 1""")
def _(t):
    one = t.lineitem.select("l_suppkey", "l_quantity", "l_returnflag", F.lit(1).alias("m"))
    tv = A.total_variation(one.where("l_returnflag='A'"), one.where("l_returnflag='R'"), ["l_suppkey"], "l_quantity", "m", "tv")
    return tv.withColumn("tv", F.round("tv", 6))


@query("A25_proportional_allocation", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_totalprice FROM lineitem JOIN orders ON l_orderkey=o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_totalprice*(l_quantity/sum(l_quantity) OVER (PARTITION BY l_orderkey)) AS by_weight,
 o_totalprice*(1.0::DOUBLE/count(*) OVER (PARTITION BY l_orderkey)) AS equal_split FROM x""")
def _(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").join(
        t.orders.select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    y = A.allocate(x, ["l_orderkey"], "o_totalprice", "l_quantity", "by_weight")
    y = A.allocate(y, ["l_orderkey"], "o_totalprice", None, "equal_split")
    return y.drop("o_totalprice")


@query("A26_capacity_load", """
WITH cap AS (SELECT l_shipdate::DATE AS day, l_suppkey AS seg, l_linenumber AS run, sum(l_extendedprice) AS capacity FROM lineitem GROUP BY ALL),
 dem AS (SELECT o_orderdate::DATE AS day, o_custkey%100 AS seg, count(*)*40.0::DOUBLE AS demand FROM orders GROUP BY ALL),
 l AS (SELECT cap.*, demand*capacity/sum(capacity) OVER (PARTITION BY day,seg) AS load FROM cap JOIN dem USING (day,seg))
SELECT day, seg, run, round(load,6) AS load, round(load/capacity*1000,6) AS ratio, CASE WHEN load/capacity*1000<0.5 THEN 'LOW' WHEN load/capacity*1000<1 THEN 'MEDIUM' ELSE 'HIGH' END AS class FROM l""")
def _(t):
    cap = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("day"), F.col("l_suppkey").alias("seg"), F.col("l_linenumber").alias("run")).agg(
        F.sum("l_extendedprice").alias("capacity"))
    dem = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 100).alias("seg")).agg(
        (F.count(F.lit(1)) * 40.0).alias("demand"))
    ld = A.allocate(cap.join(dem, ["day", "seg"]), ["day", "seg"], "demand", "capacity", "load")
    ratio = F.col("load") / F.col("capacity") * 1000
    return ld.select("day", "seg", "run", F.round("load", 6).alias("load"), F.round(ratio, 6).alias("ratio"),
                     F.when(ratio < 0.5, "LOW").when(ratio < 1, "MEDIUM").otherwise("HIGH").alias("class"))


@query("A27_residual_class", """
WITH tot AS (SELECT o_custkey%25 AS origin, sum(o_totalprice) AS m FROM orders GROUP BY 1),
 p AS (SELECT o_custkey%25 AS origin, o_orderpriority AS dest, sum(o_totalprice) AS m FROM orders WHERE o_orderstatus<>'P' GROUP BY ALL)
SELECT origin, dest, round(m,2) AS mass FROM p UNION ALL
SELECT tot.origin, 'OUTSIDE_CORRIDOR', round(greatest(tot.m-coalesce(i.m,0),0),2) FROM tot LEFT JOIN (SELECT origin, sum(m) AS m FROM p GROUP BY 1) i USING (origin)""")
def _(t):
    o = t.orders.select((F.col("o_custkey") % 25).alias("origin"), F.col("o_orderpriority").alias("dest"), "o_orderstatus", F.col("o_totalprice").alias("mass"))
    tot = o.groupBy("origin").agg(F.sum("mass").alias("mass"))
    parts = o.where("o_orderstatus <> 'P'").groupBy("origin", "dest").agg(F.sum("mass").alias("mass"))
    return A.residual_class(parts, tot, ["origin"], "dest", "mass", "OUTSIDE_CORRIDOR").withColumn("mass", F.round("mass", 2))


@query("A28_destination_share", f"""
WITH {OD}, c AS (SELECT isodow(day) AS dow, slot, origin, destination, sum(flow)::BIGINT AS flow FROM od GROUP BY ALL)
SELECT dow::INT AS dow, slot, origin, destination, flow, round(flow/sum(flow) OVER (PARTITION BY dow,slot,origin),6) AS share FROM c""")
def _(t):
    d = od(t).withColumn("dow", F.weekday("day") + 1)
    return A.share_of_group(d, ["dow", "slot", "origin"], ["destination"], "flow", "share").withColumn("share", F.round("share", 6))


@query("A29_waiting_proxy", """
WITH d AS (SELECT l_suppkey%25 AS station, dayofyear(l_shipdate)%24 AS hr, count(*) AS dep FROM lineitem GROUP BY ALL),
 b AS (SELECT o_custkey%25 AS station, dayofyear(o_orderdate)%24 AS hr, count(*) AS board FROM orders GROUP BY ALL)
SELECT station, round(sum(1800.0::DOUBLE/dep*board)/sum(board),6) AS mean_wait FROM d JOIN b USING (station,hr) GROUP BY 1""")
def _(t):
    d = t.lineitem.groupBy((F.col("l_suppkey") % 25).alias("station"), (F.dayofyear("l_shipdate") % 24).alias("hr")).agg(F.count(F.lit(1)).alias("dep"))
    b = t.orders.groupBy((F.col("o_custkey") % 25).alias("station"), (F.dayofyear("o_orderdate") % 24).alias("hr")).agg(F.count(F.lit(1)).alias("board"))
    w = d.join(b, ["station", "hr"]).withColumn("wait", F.lit(1800.0) / F.col("dep"))
    return w.groupBy("station").agg(F.round(A.weighted_mean("wait", "board"), 6).alias("mean_wait"))


@query("A30_contribution_share", """
WITH c AS (SELECT l_suppkey, abs(sum(CASE WHEN l_returnflag='R' THEN l_extendedprice ELSE 0 END)-sum(CASE WHEN l_returnflag='A' THEN l_extendedprice ELSE 0 END)) AS d FROM lineitem GROUP BY 1),
 s AS (SELECT l_suppkey, d/sum(d) OVER () AS share FROM c), k AS (SELECT * FROM s ORDER BY share DESC, l_suppkey LIMIT 5)
SELECT l_suppkey, round(share,6) AS share, round((SELECT sum(share) FROM k),6) AS top5_share FROM k""")
def _(t):
    v = F.col("l_extendedprice")
    side = lambda f: F.sum(F.when(F.col("l_returnflag") == f, v).otherwise(0.0))
    c = t.lineitem.groupBy("l_suppkey").agg(F.abs(side("R") - side("A")).alias("d"))
    top = c.withColumn("share", F.col("d") / c.agg(F.sum("d")).scalar()).orderBy(F.desc("share"), "l_suppkey").limit(5)
    return top.select("l_suppkey", F.round("share", 6).alias("share"), F.round(top.agg(F.sum("share")).scalar(), 6).alias("top5_share"))


@query("A31_duplication_inflation", """
WITH r AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS routes FROM lineitem GROUP BY 1)
SELECT o_orderpriority, round(sum(o_totalprice*routes)/sum(o_totalprice)-1,6) AS inflation FROM orders JOIN r ON o_orderkey=l_orderkey GROUP BY 1""")
def _(t):
    r = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("routes"))
    j = t.orders.join(r, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.round(A.weighted_mean("routes", "o_totalprice") - 1, 6).alias("inflation"))


ZONES_SQL = """zones AS MATERIALIZED (SELECT * FROM (SELECT o_custkey AS zone, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS p, count(*)::DOUBLE AS a, min(o_custkey%13)::DOUBLE AS x, min(o_custkey%17)::DOUBLE AS y FROM orders GROUP BY 1) ORDER BY p DESC, zone LIMIT 200),
 g AS (SELECT i.zone AS origin, j.zone AS destination, sqrt(pow(i.x-j.x,2)+pow(i.y-j.y,2)) AS d, CASE WHEN i.zone=j.zone THEN 0 ELSE i.p*j.a*exp(-0.1::DOUBLE*sqrt(pow(i.x-j.x,2)+pow(i.y-j.y,2))) END AS raw FROM zones i, zones j),
 prior AS (SELECT origin, destination, d AS distance, raw/sum(raw) OVER () AS prior FROM g)"""


def zones(t):
    c = F.col("o_custkey")
    z = t.orders.groupBy(c.alias("zone")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("a"),
                                             F.min(c % 13).cast("double").alias("x"), F.min(c % 17).cast("double").alias("y"))
    return cut_lineage(z.orderBy(F.desc("p"), "zone").limit(200))


@query("A32_gravity_prior", f"WITH {ZONES_SQL} SELECT origin, destination, round(distance,6) AS distance, round(prior*1e6,6) AS prior_ppm FROM prior")
def _(t):
    g = A.gravity(zones(t), "zone", "p", "a", "x", "y", 0.1, 200)
    return g.select("origin", "destination", F.round("distance", 6).alias("distance"), F.round(F.col("prior") * 1e6, 6).alias("prior_ppm"))


@query("A33_least_squares_scale", f"""
WITH {RIDERS}, c AS (SELECT from_station, to_station, count(*)::DOUBLE AS base, sum(mass)::DOUBLE AS y FROM riders GROUP BY ALL),
 s AS (SELECT sum(base*y)/sum(base*base) AS s FROM c WHERE (from_station+to_station)%3=0)
SELECT from_station, to_station, round(CASE WHEN (from_station+to_station)%3=0 THEN y ELSE base*(SELECT s FROM s) END,6) AS fitted FROM c""")
def _(t):
    c = riders(t).groupBy("from_station", "to_station").agg(F.count(F.lit(1)).cast("double").alias("base"), F.sum("mass").cast("double").alias("y"))
    c = c.withColumn("seen", (F.col("from_station") + F.col("to_station")) % 3 == 0)
    return A.scale_fit(c, "base", "y", "seen", "fitted").select("from_station", "to_station", F.round("fitted", 6).alias("fitted"))


@query("A34_daily_balance", f"""
WITH {OD}, d AS (SELECT day, origin AS station, slot, 0::BIGINT AS inn, flow AS outt FROM od UNION ALL SELECT day, destination, slot, flow, 0 FROM od),
 c AS (SELECT day, station, slot, sum(inn) AS inn, sum(outt) AS outt FROM d GROUP BY ALL)
SELECT day, count(*) AS cells, sum(inn)::BIGINT AS in_total, sum(outt)::BIGINT AS out_total, count(*)=25*102 AS complete, sum(inn)=sum(outt) AS balanced FROM c GROUP BY 1""")
def _(t):
    ends = od(t).select("day", "slot", F.explode(F.array(
        F.struct(F.col("origin").alias("station"), F.lit(0).cast("bigint").alias("inn"), F.col("flow").alias("outt")),
        F.struct(F.col("destination").alias("station"), F.col("flow").alias("inn"), F.lit(0).cast("bigint").alias("outt")))).alias("e"))
    c = ends.groupBy("day", "e.station", "slot").agg(F.sum("e.inn").alias("inn"), F.sum("e.outt").alias("outt"))
    return c.groupBy("day").agg(F.count(F.lit(1)).alias("cells"), F.sum("inn").alias("in_total"), F.sum("outt").alias("out_total")).withColumns(
        {"complete": F.col("cells") == 25 * 102, "balanced": F.col("in_total") == F.col("out_total")})


@query("A35_low_day_flag", """
WITH d AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1), m AS (SELECT isodow(day) AS dow, median(total) AS med FROM d GROUP BY 1)
SELECT day, round(total,2) AS total, round(total/med,6) AS ratio, total/med<0.05 AS low FROM d JOIN m ON isodow(day)=dow""")
def _(t):
    d = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("total")).withColumn("dow", F.weekday("day"))
    m = Q.median(d, ["dow"], "total", 100000.0, "med")
    ratio = F.col("total") / F.col("med")
    return d.join(m, "dow").select("day", F.round("total", 2).alias("total"), F.round(ratio, 6).alias("ratio"), (ratio < 0.05).alias("low"))


@query("A36_multi_level_counters", """
SELECT l_returnflag, l_linestatus, l_linenumber, grouping(l_returnflag,l_linestatus,l_linenumber)::BIGINT AS level_id, sum(l_quantity::BIGINT)::BIGINT AS mass, count(*) AS n
FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag,l_linestatus,l_linenumber))""")
def _(t):
    x = t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    return A.level_counts(x, ["l_returnflag", "l_linestatus", "l_linenumber"],
                          [[], ["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus", "l_linenumber"]], "q")


@query("A37_set_label", """
SELECT l_suppkey, l_shipdate::DATE AS day, CASE WHEN count(DISTINCT l_returnflag)=1 THEN 'ONLY_'||min(l_returnflag) ELSE 'MIXED' END AS label FROM lineitem GROUP BY ALL""")
def _(t):
    return t.lineitem.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day")).agg(
        F.when(F.min("l_returnflag") == F.max("l_returnflag"), F.concat(F.lit("ONLY_"), F.min("l_returnflag"))).otherwise("MIXED").alias("label"))


@query("A38_shard_merge", """
SELECT l_returnflag, count(*) AS cohorts, sum(l_quantity)::BIGINT AS mass, max(l_extendedprice) AS peak, min(l_discount) AS low FROM lineitem GROUP BY 1""")
def _(t):
    # every order-key shard is summarised on its own, then sums are summed, maxima and minima kept
    shard = t.lineitem.groupBy("l_returnflag", F.pmod("l_orderkey", F.lit(50)).alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("m"), F.max("l_extendedprice").alias("hi"), F.min("l_discount").alias("lo"))
    return shard.groupBy("l_returnflag").agg(F.sum("n").alias("cohorts"), F.sum("m").cast("bigint").alias("mass"), F.max("hi").alias("peak"), F.min("lo").alias("low"))


@query("A39_conservation_gates", f"""
WITH {OD} SELECT sum(flow)::BIGINT AS total, sum(flow_a+flow_n+flow_r)::BIGINT AS parts, (SELECT sum(l_quantity)::BIGINT FROM lineitem JOIN orders ON l_orderkey=o_orderkey) AS source,
 sum(flow)=sum(flow_a+flow_n+flow_r) AS parts_ok FROM od""")
def _(t):
    d = od(t).agg(F.sum("flow").alias("total"), F.sum(F.col("flow_a") + F.col("flow_n") + F.col("flow_r")).alias("parts"))
    src = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").agg(F.sum("l_quantity").cast("bigint"))
    return d.withColumns({"source": src.scalar(), "parts_ok": F.col("total") == F.col("parts")})


@query("A40_top_mass", """
SELECT l_partkey, sum(l_quantity)::BIGINT AS mass FROM lineitem GROUP BY 1 ORDER BY mass DESC, l_partkey LIMIT 20""")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("mass")).orderBy(F.desc("mass"), "l_partkey").limit(20)


@query("A41_pooled_profile", f"""
WITH {TAPS}, b AS (SELECT ((us//1000000)%86400)//900 AS bin, count(*) AS n FROM taps GROUP BY 1)
SELECT bin, n, (SELECT arg_min(bin, (n,bin)) FROM b) AS trough, round(sum(CASE WHEN bin<20 THEN n ELSE 0 END) OVER ()/sum(n) OVER (),6) AS overnight FROM b""")
def _(t):
    b = taps(t).groupBy(F.floor(F.floor(F.col("us") / 1_000_000) % clocks.DAY_S / 900).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    g = b.agg(F.struct(F.min_by("bin", F.struct("n", "bin")).alias("trough"),
                       (F.sum(F.when(F.col("bin") < 20, F.col("n")).otherwise(0)) / F.sum("n")).alias("share")))
    return b.withColumn("g", g.scalar()).select("bin", "n", F.col("g.trough").alias("trough"), F.round("g.share", 6).alias("overnight"))


@query("A42_raw_event_profile", """
SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS users, count_if(event_type='error')::BIGINT AS errors,
 count(DISTINCT event_type) AS types, count_if(value IS NULL)::BIGINT AS null_values FROM events""")
def _(t):
    return t.events.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("user_id").alias("users"),
                        F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("event_type").alias("types"),
                        F.count_if(F.col("value").isNull()).alias("null_values"))


@query("A43_bag_signature", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return A.cohorts(t.lineitem, ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"], "n")


@query("A44_component_pair_mass", f"""
WITH {OD} SELECT least(a.n_regionkey,b.n_regionkey) AS low, greatest(a.n_regionkey,b.n_regionkey) AS high, sum(flow)::BIGINT AS mass, count(DISTINCT (origin,destination)) AS od_pairs
FROM od JOIN nation a ON origin=a.n_nationkey JOIN nation b ON destination=b.n_nationkey WHERE a.n_regionkey<>b.n_regionkey GROUP BY 1,2""")
def _(t):
    comp = t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("component"))
    from ledgerline.operators.graph import component_pair_mass
    return component_pair_mass(od(t), comp, "origin", "destination", "flow")


@query("A45_endpoint_diagnosis", """
WITH d AS (SELECT c_custkey, CASE WHEN c_mktsegment='BUILDING' THEN 'IN_SCOPE' WHEN s_suppkey IS NOT NULL THEN 'KNOWN_ELSEWHERE' WHEN c_acctbal<0 THEN 'CLOSED' ELSE 'UNKNOWN' END AS class
  FROM customer LEFT JOIN supplier ON c_custkey=s_suppkey)
SELECT class, count(DISTINCT c_custkey) AS codes, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(38,2) AS touch_mass, count(*) AS trips FROM d JOIN orders ON o_custkey=c_custkey GROUP BY 1""")
def _(t):
    from ledgerline.operators.reconcile import evidence_class
    known = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.lit(True).alias("known"))
    c = t.customer.join(known, "c_custkey", "left")
    c = c.withColumn("class", evidence_class([("IN_SCOPE", F.col("c_mktsegment") == "BUILDING"), ("KNOWN_ELSEWHERE", F.col("known")),
                                              ("CLOSED", F.col("c_acctbal") < 0)], "UNKNOWN"))
    j = t.orders.join(c.select("c_custkey", "class"), F.col("o_custkey") == F.col("c_custkey"))
    per = j.groupBy("class", "c_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("m"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("class").agg(F.count(F.lit(1)).alias("codes"), F.sum("m").cast("decimal(38,2)").alias("touch_mass"), F.sum("n").alias("trips"))


@query("A46_code_family_mass", f"""
WITH {RIDERS}, f AS (SELECT *, from_station>=20 AS o_in, to_station>=20 AS d_in, exit-entry AS dur FROM riders)
SELECT CASE WHEN o_in AND d_in THEN 'BOTH' WHEN o_in OR d_in THEN 'ONE' ELSE 'NONE' END AS family, sum(mass)::BIGINT AS mass, sum(CASE WHEN o_in THEN mass ELSE 0 END)::BIGINT AS ride_mass,
 sum(CASE WHEN d_in THEN mass ELSE 0 END)::BIGINT AS alight_mass, median(dur) AS median_duration FROM f GROUP BY 1""")
def _(t):
    f = riders(t).withColumns({"o_in": F.col("from_station") >= 20, "d_in": F.col("to_station") >= 20, "dur": F.col("exit") - F.col("entry")})
    f = f.withColumn("family", F.when(F.col("o_in") & F.col("d_in"), "BOTH").when(F.col("o_in") | F.col("d_in"), "ONE").otherwise("NONE"))
    m = F.col("mass")
    g = f.groupBy("family").agg(F.sum("mass").alias("mass"), F.sum(F.when(F.col("o_in"), m).otherwise(0)).alias("ride_mass"),
                                F.sum(F.when(F.col("d_in"), m).otherwise(0)).alias("alight_mass"))
    return g.join(Q.median(f, ["family"], "dur", 3600.0, "median_duration"), "family")


@query("A48_evidence_dossier", """
WITH e AS (SELECT DISTINCT c_nationkey AS code, 'segment' AS kind, c_mktsegment AS item FROM customer UNION SELECT s_nationkey, 'supplier', s_name FROM supplier
 UNION SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation)
SELECT code, kind, item, (count(*) OVER (PARTITION BY code, kind))::BIGINT AS items_of_kind FROM e""")
def _(t):
    from ledgerline.operators.reconcile import evidence_rows
    return evidence_rows({"segment": t.customer.select(F.col("c_nationkey").alias("code"), F.col("c_mktsegment").alias("item")),
                          "supplier": t.supplier.select(F.col("s_nationkey").alias("code"), F.col("s_name").alias("item")),
                          "region": t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").cast("string").alias("item"))})


@query("A51_evidence_tier_reconciliation", f"""
WITH {RIDERS}, node AS (SELECT n_nationkey AS code, n_regionkey FROM nation WHERE n_regionkey<>4), name AS (SELECT DISTINCT s_nationkey AS code FROM supplier),
 st AS (SELECT DISTINCT from_station AS code FROM riders UNION SELECT DISTINCT to_station FROM riders),
 cls AS (SELECT code, CASE WHEN node.code IS NOT NULL THEN 'LINE_AWARE_NODE' WHEN name.code IS NOT NULL THEN 'NAME_REVIEW' ELSE 'NONE' END AS tier FROM st LEFT JOIN node USING (code) LEFT JOIN name USING (code))
SELECT CASE WHEN a.tier='LINE_AWARE_NODE' AND b.tier='LINE_AWARE_NODE' THEN 'RECOVERABLE' WHEN a.tier='LINE_AWARE_NODE' THEN 'BLOCKED_DESTINATION' WHEN b.tier='LINE_AWARE_NODE' THEN 'BLOCKED_ORIGIN' ELSE 'BLOCKED_BOTH' END AS status,
 sum(mass)::BIGINT AS mass, count(*) AS n FROM riders JOIN cls a ON from_station=a.code JOIN cls b ON to_station=b.code GROUP BY 1""")
def _(t):
    from ledgerline.operators.reconcile import evidence_class
    r = riders(t).groupBy("from_station", "to_station").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n"))
    node = t.nation.where("n_regionkey <> 4").select(F.col("n_nationkey").alias("code"), F.lit(True).alias("node"))
    name = t.supplier.select(F.col("s_nationkey").alias("code"), F.lit(True).alias("named")).distinct()
    codes = r.select(F.explode(F.array("from_station", "to_station")).alias("code")).distinct()
    cls = codes.join(node, "code", "left").join(name, "code", "left").select(
        "code", evidence_class([("LINE_AWARE_NODE", F.col("node")), ("NAME_REVIEW", F.col("named"))], "NONE").alias("tier"))
    o = cls.select(F.col("code").alias("from_station"), (F.col("tier") == "LINE_AWARE_NODE").alias("o_ok"))
    d = cls.select(F.col("code").alias("to_station"), (F.col("tier") == "LINE_AWARE_NODE").alias("d_ok"))
    status = F.when(F.col("o_ok") & F.col("d_ok"), "RECOVERABLE").when(F.col("o_ok"), "BLOCKED_DESTINATION").when(F.col("d_ok"), "BLOCKED_ORIGIN").otherwise("BLOCKED_BOTH")
    return r.join(o, "from_station").join(d, "to_station").groupBy(status.alias("status")).agg(F.sum("mass").alias("mass"), F.sum("n").alias("n"))
