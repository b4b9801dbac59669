"""Projection, filter and data-contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import clocks
from ledgerline.operators import contracts as C
from ledgerline.plans.views import OD, RIDES, TAPS, od, rides, taps
from ledgerline.registry import query
from ledgerline.session import fresh_path
from ledgerline.sources import sinks as SK


@query("P01_exact_int_coercion", """
WITH x AS (SELECT event_id, CASE event_id%5 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN user_id::VARCHAR||'.0' WHEN 2 THEN value::VARCHAR WHEN 3 THEN '9007199254740993' ELSE 'n/a' END AS s FROM events),
 y AS (SELECT event_id, TRY_CAST(s AS DOUBLE) AS d FROM x)
SELECT event_id, CASE WHEN d=floor(d) AND abs(d)<9007199254740992 THEN d::BIGINT END AS value_int, NOT coalesce(d=floor(d) AND abs(d)<9007199254740992,false) AS bad FROM y""")
def _(t):
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    s = (F.when(k == 0, u).when(k == 1, F.concat(u, F.lit(".0"))).when(k == 2, F.col("value").cast("string"))
         .when(k == 3, F.lit("9007199254740993")).otherwise("n/a"))
    e = t.events.select("event_id", C.exact_int(s).alias("value_int"))
    return e.withColumn("bad", F.col("value_int").isNull())


@query("P02_date_normalisation", """
WITH cov AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem), x AS (SELECT o_orderkey, CASE WHEN o_orderkey%4=3 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders)
SELECT o_orderkey, x.day, cov.day IS NOT NULL AS covered FROM x LEFT JOIN cov USING (day)""")
def _(t):
    k = F.col("o_orderkey") % 4
    s = (F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
         .when(k == 2, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".0"))).otherwise("31/12/1997"))
    x = t.orders.select("o_orderkey", clocks.normal_date(s).alias("day"))
    cov = t.lineitem.select(F.col("l_shipdate").cast("date").alias("day")).distinct().withColumn("covered", F.lit(True))
    return x.join(cov, "day", "left").fillna(False, ["covered"])


@query("P03_slot_clock", """
WITH x AS (SELECT o_orderkey, ((o_orderkey%26)*10000 + (o_orderkey%7)*1000 + (o_orderkey%3)*5)::INT AS c FROM orders), y AS (SELECT *, c//10000 AS h, (c//100)%100 AS m, c%100 AS s FROM x)
SELECT o_orderkey, CASE WHEN h<24 AND m<60 AND s=0 AND h*60+m>=360 AND h*60+m<1380 AND (h*60+m)%10=0 THEN ((h*60+m-360)//10)::INT END AS slot FROM y""")
def _(t):
    k = F.col("o_orderkey")
    c = ((k % 26) * 10000 + (k % 7) * 1000 + (k % 3) * 5).cast("int")
    return t.orders.select("o_orderkey", clocks.clock_to_slot(c).alias("slot"))


@query("P04_partition_contract", """
SELECT count(*) AS "rows", count_if(o_orderdate IS NULL OR o_custkey IS NULL)::BIGINT AS nulls, count_if(year(o_orderdate)<>1995+(o_orderkey%7))::BIGINT AS wrong_partition FROM orders""")
def _(t):
    from pyspark.sql import types as T
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    C.check_schema(o, [("o_orderkey", T.LongType), ("o_custkey", T.LongType), ("o_orderdate", T.TimestampNTZType)])
    return C.violations(o, {"nulls": F.col("o_orderdate").isNotNull() & F.col("o_custkey").isNotNull(),
                            "wrong_partition": F.year("o_orderdate") == 1995 + F.col("o_orderkey") % 7})


@query("P05_decomposition_identity", f"""
WITH {OD} SELECT count(*) AS "rows", count_if(least(flow,flow_a,flow_n,flow_r)<0)::BIGINT AS negative, count_if(flow<>flow_a+flow_n+flow_r)::BIGINT AS broken FROM od""")
def _(t):
    return C.violations(od(t), {"negative": F.least("flow", "flow_a", "flow_n", "flow_r") >= 0,
                                "broken": F.col("flow") == F.col("flow_a") + F.col("flow_n") + F.col("flow_r")})


@query("P06_diagonal_exclusion", f"WITH {OD} SELECT day, slot, origin, destination, flow FROM od WHERE origin<>destination")
def _(t):
    return od(t).where("origin <> destination").select("day", "slot", "origin", "destination", "flow")


@query("P07_authority_membership", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal>0) GROUP BY 1")
def _(t):
    return C.unknown_keys(t.orders.select("o_custkey"), "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey")


@query("P08_half_open_range", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate>=TIMESTAMP '1996-01-01' AND o_orderdate<TIMESTAMP '1997-01-01'""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.where((d >= F.expr("TIMESTAMP_NTZ '1996-01-01'")) & (d < F.expr("TIMESTAMP_NTZ '1997-01-01'"))).select("o_orderkey", "o_orderdate")


@query("P09_service_day", """
SELECT event_id, (ts - INTERVAL 4 HOUR)::DATE AS service_date, ((epoch_us(ts)//1000000 - 14400) % 86400)::BIGINT AS service_second FROM events""")
def _(t):
    return t.events.select("event_id", clocks.service_date(F.col("ts")).alias("service_date"), clocks.service_second(F.col("ts")).alias("service_second"))


def reject_reasons():
    return [("BARRIER_TYPE", F.col("event_type") == "error"), ("LOW_VALUE", F.col("value") < 5), ("BAD_STATION", F.col("station") == 22)]


REASONS = "CASE WHEN event_type='error' THEN 'BARRIER_TYPE' WHEN value<5 THEN 'LOW_VALUE' WHEN station=22 THEN 'BAD_STATION' ELSE 'ACCEPTED' END"


@query("P10_reject_routing", f"WITH {TAPS} SELECT {REASONS} AS reason, count(*) AS n, min(event_id) AS first_event, round(sum(value),4) AS value, count(*) AS counted FROM taps GROUP BY 1")
def _(t):
    """Good and rejected rows written to their folders in one pass; what is read back beside what the write counted."""
    back, counts = SK.route_rejects(taps(t), reject_reasons(), fresh_path(t.spark, "routed"))
    counted = F.coalesce(*[F.when(F.col("reason") == n, F.lit(c)) for n, c in counts.items()])
    return back.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("value")).withColumn("counted", counted.cast("bigint"))


@query("P11_period_labels", """
WITH x AS (SELECT event_id, event_id%2 AS line, strftime(ts,'%H:%M:%S') AS c FROM events)
SELECT event_id, CASE WHEN line=1 THEN CASE WHEN c>='07:00:00' AND c<'08:30:00' THEN 'AM' WHEN c>='09:00:00' AND c<'16:00:00' THEN 'OFF' WHEN c>='17:00:00' AND c<'19:30:00' THEN 'PM' ELSE 'OTHER' END
 ELSE CASE WHEN c>='07:00:00' AND c<'09:00:00' THEN 'AM' WHEN c>='09:00:00' AND c<'16:00:00' THEN 'OFF' WHEN c>='17:30:00' AND c<'19:00:00' THEN 'PM' ELSE 'OTHER' END END AS period FROM x""")
def _(t):
    c = F.date_format("ts", "HH:mm:ss")
    def label(*spans):
        out = None
        for name, a, b in spans:
            cond = (c >= a) & (c < b)
            out = F.when(cond, name) if out is None else out.when(cond, name)
        return out.otherwise("OTHER")
    one = label(("AM", "07:00:00", "08:30:00"), ("OFF", "09:00:00", "16:00:00"), ("PM", "17:00:00", "19:30:00"))
    two = label(("AM", "07:00:00", "09:00:00"), ("OFF", "09:00:00", "16:00:00"), ("PM", "17:30:00", "19:00:00"))
    return t.events.select("event_id", F.when(F.col("event_id") % 2 == 1, one).otherwise(two).alias("period"))


@query("P12_column_discovery", "SELECT 'c_nationkey' AS \"column\", count(*) AS \"rows\" FROM customer")
def _(t):
    return C.first_numeric_column(t.customer, ["c_name", "station_id", "c_custkey", "c_nationkey"], 25)


@query("P13_feasibility_gate", f"""
WITH {RIDES} SELECT ride_id, dep-lag_dep AS access_gap, (dep-lag_dep>=15 AND arr-dep>=15) AS feasible FROM (SELECT *, lag(dep) OVER (PARTITION BY line, from_station ORDER BY dep, ride_id) AS lag_dep FROM rides) WHERE lag_dep IS NOT NULL""")
def _(t):
    from ledgerline import skew
    r = skew.neighbour(rides(t), ["line", "from_station"], ["dep", "ride_id"], skew.span("dep", 86400 * 30), ["dep"], "prev")
    gap = F.col("dep") - F.col("prev.dep")
    return r.where("prev is not null").select("ride_id", gap.alias("access_gap"), ((gap >= 15) & (F.col("arr") - F.col("dep") >= 15)).alias("feasible"))


@query("P14_reason_histogram", f"WITH {TAPS} SELECT {REASONS} AS reason, sum(event_id%3)::BIGINT AS n FROM taps GROUP BY 1")
def _(t):
    return C.reason_histogram(C.with_reason(taps(t).withColumn("mass", F.col("event_id") % 3), reject_reasons()), mass="mass")


@query("P15_gate_record", f"""
WITH {OD}, f AS (SELECT count(*) AS n, sum(flow) AS f, sum(flow_a+flow_n+flow_r) AS p, count(DISTINCT origin) AS o FROM od)
SELECT n>0 AS has_rows, f=p AS parts_sum, o=25 AS all_origins, (n>0 AND f=p AND o=25) AS qualified, CASE WHEN n>0 AND f=p AND o=25 THEN 'QUALIFIED' ELSE 'REJECTED' END AS status FROM f""")
def _(t):
    f = od(t).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("flow").alias("f"), F.sum(F.col("flow_a") + F.col("flow_n") + F.col("flow_r")).alias("p"))
    f = f.agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("o"))
    return C.gates(f, {"has_rows": F.col("n") > 0, "parts_sum": F.col("f") == F.col("p"), "all_origins": F.col("o") == 25})
