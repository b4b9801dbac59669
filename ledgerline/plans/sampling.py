"""Sampling and split queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ledgerline.functions import hashing
from ledgerline.operators import sampling as X
from ledgerline.plans.views import TAPS, taps
from ledgerline.registry import query


def hexnum(text: str, digits: int) -> str:
    return f"('0x'||substr(sha256({text}),1,{digits}))::BIGINT"


@query("X01_hash_shard", f"SELECT o_orderkey, ({hexnum('o_orderkey::VARCHAR', 8)} % 50)::INT AS shard FROM orders")
def _(t):
    return X.hash_shard(t.orders.select("o_orderkey"), X.keyed("o_orderkey"), 50)


@query("X02_capped_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY sha1('v1|'||o_orderkey::VARCHAR) LIMIT 500")
def _(t):
    return X.capped_sample(t.orders.select("o_orderkey", "o_custkey"), X.keyed("o_orderkey", salt="v1|"), 500)


@query("X03_cross_fit_folds", f"""
WITH f AS (SELECT o_totalprice, {hexnum("'fold|'||o_custkey::VARCHAR", 15)} % 5 AS fold FROM orders) SELECT CASE WHEN fold=0 THEN 'HELDOUT' ELSE 'TRAIN' END AS side, count(*) AS "rows", round(sum(o_totalprice),2) AS mass FROM f GROUP BY 1""")
def _(t):
    return X.folds(t.orders, X.keyed("o_custkey", salt="fold|"), 5, mass="o_totalprice")[1].withColumn("mass", F.round("mass", 2))


@query("X04_card_split", f"""
WITH g AS (SELECT event_id, sha256('group:'||user_id::VARCHAR) AS token FROM events), x AS (SELECT event_id, {hexnum("'split:'||token", 8)} % 10 AS d FROM g)
SELECT event_id, CASE WHEN d=0 THEN 'validation' WHEN d IN (1,2) THEN 'test' ELSE 'train' END AS split FROM x""")
def _(t):
    return t.events.select("event_id", hashing.split_name(hashing.group_token(F.col("user_id").cast("string"))).alias("split"))


@query("X05_stratified_holdout", """
WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus ORDER BY sha256('h|'||o_orderkey::VARCHAR)))
SELECT o_orderkey, k <= CASE WHEN n>20 THEN least(n-20, greatest(1, round_even(n*0.2::DOUBLE,0)::BIGINT)) ELSE 0 END AS held_out FROM r""")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return X.stratified_holdout(o, ["o_orderpriority", "o_orderstatus"], X.keyed("o_orderkey", salt="h|"), 0.2, 20).select("o_orderkey", "held_out")


@query("X06_target_masks", f"""
SELECT p_partkey, ({hexnum("'p_size|'||p_partkey::VARCHAR", 13)})::DOUBLE/4503599627370496.0::DOUBLE < 0.3::DOUBLE AS mask_p_size, ({hexnum("'p_brand|'||p_partkey::VARCHAR", 13)})::DOUBLE/4503599627370496.0::DOUBLE < 0.3::DOUBLE AS mask_p_brand FROM part""")
def _(t):
    return X.target_masks(t.part.select("p_partkey"), X.keyed("p_partkey"), ["p_size", "p_brand"], 0.3)


def poisson_sql(u: str) -> str:
    total, term, parts = 0.0, math.exp(-1.0), []
    for k in range(12):
        total += term
        parts.append(f"({u}>={total!r}::DOUBLE)::INT")
        term /= k + 1
    return "+".join(parts)


BOOT = f"""{TAPS}, rep AS (SELECT unnest(range(6)) AS replicate), u AS (SELECT replicate, station, hour(ts)::INT AS hr, ({hexnum("replicate::VARCHAR||'|'||event_id::VARCHAR", 13)})::DOUBLE/4503599627370496.0::DOUBLE AS u FROM taps, rep),
 bc AS (SELECT replicate::INT AS replicate, station, hr, sum({poisson_sql('u')})::BIGINT AS x FROM u GROUP BY ALL HAVING sum({poisson_sql('u')})>0)"""


def boot(t):
    return X.bootstrap_counts(taps(t).select("event_id", "station", F.hour("ts").alias("hr")), ["station", "hr"], X.keyed("event_id"), 6)


@query("X07_poisson_bootstrap", f"WITH {BOOT} SELECT * FROM bc")
def _(t):
    return boot(t)


@query("X08_replicate_stability", f"""
WITH {BOOT}, pk AS (SELECT replicate, station, arg_min(hr,(-x,hr)) AS hr FROM bc GROUP BY ALL), g AS (SELECT station, hr, count(DISTINCT replicate) AS hits FROM pk GROUP BY ALL)
SELECT station, hr, hits, round(hits/6.0::DOUBLE,6) AS recovered, CASE WHEN hits>=5 THEN 'STABLE' WHEN hits>=4 THEN 'LIKELY' ELSE 'WEAK' END AS label FROM g""")
def _(t):
    peak = boot(t).groupBy("replicate", "station").agg(F.min_by("hr", F.struct(-F.col("x"), F.col("hr"))).alias("hr"))
    return X.stability(peak, ["station", "hr"], "replicate", 6).withColumn("recovered", F.round("recovered", 6))


@query("X09_partition_conservation", f"""
WITH s AS (SELECT {hexnum('o_orderkey::VARCHAR', 8)} % 8 AS part, o_totalprice::DECIMAL(18,2) AS m FROM orders) SELECT count(DISTINCT part) AS parts, count(*) AS rows_in_parts, (SELECT count(*) FROM orders) AS rows_total, sum(m)::DECIMAL(38,2) AS mass_in_parts, true AS conserved FROM s""")
def _(t):
    o = X.hash_shard(t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("m")), X.keyed("o_orderkey"), 8)
    per = o.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"))
    whole = t.orders.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("m"))).scalar()
    g = per.agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("rows_in_parts"), F.sum("m").cast("decimal(38,2)").alias("mass_in_parts")).withColumn("w", whole)
    return g.select("parts", "rows_in_parts", F.col("w.n").alias("rows_total"), "mass_in_parts",
                    ((F.col("rows_in_parts") == F.col("w.n")) & (F.col("mass_in_parts") == F.col("w.m"))).alias("conserved"))
