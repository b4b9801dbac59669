"""Sort, limit and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import clocks
from ledgerline.operators import topk as K
from ledgerline.plans.views import RIDERS, riders, taps
from ledgerline.registry import query


@query("T01_deterministic_order", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_totalprice, o_orderkey")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), "o_totalprice", "o_orderkey")


@query("T02_top_n", "SELECT o_custkey, count(*) AS activity FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("activity")).orderBy(F.desc("activity"), "o_custkey").limit(200)


@query("T03_top_one_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)=1""")
def _(t):
    return K.best_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@query("T04_beam", """
WITH s AS (SELECT user_id, event_type, event_id, -value/50.0::DOUBLE AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC, event_id) AS beam_rank, sum(exp(score)) OVER (PARTITION BY user_id, event_type) AS tot FROM s)
SELECT user_id, event_type, event_id, round(score,6) AS score, beam_rank::INT AS beam_rank, round(least(1.0,sum(exp(score)/tot) OVER (PARTITION BY user_id, event_type)),6) AS retained FROM r WHERE beam_rank<=8""")
def _(t):
    s = t.events.select("user_id", "event_type", "event_id", (-F.col("value") / 50.0).alias("score"))
    b = K.beam(s, ["user_id", "event_type"], "score", ["event_id"], 8)
    return b.select("user_id", "event_type", "event_id", F.round("score", 6).alias("score"), "beam_rank", F.round("retained", 6).alias("retained"))


@query("T05_suppression", """
WITH x AS (SELECT event_type, event_id, epoch_us(ts)//1000000 AS s, value FROM events),
 l AS (SELECT event_type, list_reduce(list([s] ORDER BY value DESC, event_id), lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: abs(z-y[1])<600))=0 THEN acc||y ELSE acc END) AS kept FROM x GROUP BY 1),
 k AS (SELECT event_type, unnest(kept) AS s FROM l)
SELECT event_type, s, arg_min(event_id,(-value,event_id)) AS event_id, max(value) AS value FROM x JOIN k USING (event_type, s) GROUP BY 1,2""")
def _(t):
    x = taps(t).select("event_type", "event_id", F.floor(F.col("us") / 1_000_000).alias("s"), "value")
    return K.suppress(x, ["event_type"], "s", [-F.col("value"), F.col("event_id")], 600, clocks.DAY_S)


@query("T06_tie_rejection", """
WITH x AS (SELECT user_id, event_type, floor(value/10)::BIGINT AS score FROM events), b AS (SELECT user_id, max(score) AS score FROM x GROUP BY 1), top AS (SELECT x.* FROM x JOIN b USING (user_id, score))
SELECT user_id, score, event_type FROM top WHERE user_id IN (SELECT user_id FROM top GROUP BY 1 HAVING count(DISTINCT event_type)=1)""")
def _(t):
    x = t.events.select("user_id", "event_type", F.floor(F.col("value") / 10).alias("score"))
    return K.reject_ties(x, ["user_id"], "score", "event_type").select("user_id", "score", "event_type")


@query("T07_greedy_matching", """
WITH li AS (SELECT l_orderkey, l_suppkey, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
 p AS (SELECT o_custkey AS customer, l_suppkey AS supplier, min(abs(price-o_totalprice)) AS gap FROM li JOIN orders ON l_orderkey=o_orderkey GROUP BY ALL),
 l AS (SELECT list_reduce(list([{'c':customer,'s':supplier,'g':gap}] ORDER BY gap, customer, supplier), lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: z.c=y[1].c OR z.s=y[1].s))=0 THEN acc||y ELSE acc END) AS kept FROM p),
 u AS (SELECT unnest(kept) AS k FROM l)
SELECT k.c AS customer, k.s AS supplier, k.g AS gap FROM u""")
def _(t):
    li = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_extendedprice").alias("price"))
    p = li.join(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = p.groupBy(F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier")).agg(F.min(F.abs(F.col("price") - F.col("o_totalprice"))).alias("gap"))
    return K.greedy_match(p, [], "customer", "supplier", [F.col("gap"), F.col("customer"), F.col("supplier")])
