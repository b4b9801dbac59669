"""Domain views of the supplied tables, each beside the SQL that defines it.

Taps come from ``events``, demand cells from orders and lineitem, rides
(scheduled departures and arrivals between stations) from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import clocks

TAPS = """taps AS (SELECT event_id, ts, user_id, event_type, value, (event_id % 23)::INT AS station, (event_id % 5)::INT AS line,
  CASE WHEN event_type IN ('view','click') THEN 1 WHEN event_type IN ('purchase','signup') THEN 0 END AS status,
  epoch_us(ts) AS us FROM events)"""


def taps(t):
    """Tap events: status 1 entry, 0 exit, null a barrier."""
    ev = F.col("event_type")
    return t.events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        (F.col("event_id") % 23).cast("int").alias("station"), (F.col("event_id") % 5).cast("int").alias("line"),
        F.when(ev.isin("view", "click"), 1).when(ev.isin("purchase", "signup"), 0).alias("status"),
        clocks.epoch_us(F.col("ts")).alias("us"))


OD = """od AS (SELECT o.o_orderdate::DATE AS day, (o.o_orderkey % 102)::INT AS slot, c.c_nationkey AS origin, s.s_nationkey AS destination,
  sum(l_quantity)::BIGINT AS flow, sum(CASE WHEN l_returnflag='A' THEN l_quantity ELSE 0 END)::BIGINT AS flow_a,
  sum(CASE WHEN l_returnflag='N' THEN l_quantity ELSE 0 END)::BIGINT AS flow_n, sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END)::BIGINT AS flow_r
  FROM lineitem JOIN orders o ON l_orderkey=o_orderkey JOIN customer c ON o_custkey=c_custkey JOIN supplier s ON l_suppkey=s_suppkey
  GROUP BY ALL)"""


def od(t):
    """Demand cells by day, slot, origin and destination nation, split into three purposes."""
    q = F.col("l_quantity")
    part = lambda f: F.sum(F.when(F.col("l_returnflag") == f, q).otherwise(0.0)).cast("bigint")
    line = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    return (line.join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 102).cast("int").alias("slot"),
                     F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("destination"))
            .agg(F.sum(q).cast("bigint").alias("flow"), part("A").alias("flow_a"), part("N").alias("flow_n"), part("R").alias("flow_r")))


RIDES = """rides AS (SELECT l_orderkey*8+l_linenumber AS ride_id, min(l_suppkey % 25)::INT AS from_station, min((l_suppkey+1+l_partkey%7) % 25)::INT AS to_station,
  min(l_suppkey % 6)::INT AS line, min(epoch_us(l_shipdate)//1000000 + (l_orderkey*97 % 86400)) AS dep,
  min(epoch_us(l_shipdate)//1000000 + (l_orderkey*97 % 86400) + 120 + l_quantity::BIGINT*60) AS arr
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def rides(t):
    """Scheduled rides: one departure and arrival (epoch seconds) per order line."""
    base = clocks.epoch_s(F.col("l_shipdate")) + F.col("l_orderkey") * 97 % 86400
    return (t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
                F.min(F.col("l_suppkey") % 25).cast("int").alias("from_station"),
                F.min((F.col("l_suppkey") + 1 + F.col("l_partkey") % 7) % 25).cast("int").alias("to_station"),
                F.min(F.col("l_suppkey") % 6).cast("int").alias("line"), F.min(base).alias("dep"),
                F.min(base + 120 + F.col("l_quantity").cast("bigint") * 60).alias("arr"))
            .select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ride_id"), "from_station", "to_station", "line", "dep", "arr"))


RIDERS = """riders AS (SELECT o_orderkey AS rider_id, (o_custkey % 25)::INT AS from_station, ((o_custkey+1+o_orderkey%7) % 25)::INT AS to_station,
  epoch_us(o_orderdate)//1000000 + (o_orderkey*61 % 86400) AS entry, epoch_us(o_orderdate)//1000000 + (o_orderkey*61 % 86400) + 14400 + (o_custkey % 50)*3600 AS exit,
  (1 + o_custkey % 3)::BIGINT AS mass FROM orders)"""


def riders(t):
    """Travellers: entry and exit station and time, with a mass."""
    entry = clocks.epoch_s(F.col("o_orderdate")) + F.col("o_orderkey") * 61 % 86400
    return t.orders.select(
        F.col("o_orderkey").alias("rider_id"), (F.col("o_custkey") % 25).cast("int").alias("from_station"),
        ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 7) % 25).cast("int").alias("to_station"),
        entry.alias("entry"), (entry + 14400 + F.col("o_custkey") % 50 * 3600).alias("exit"),
        (1 + F.col("o_custkey") % 3).alias("mass"))
