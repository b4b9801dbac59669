"""Set-operation and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.functions import clocks
from ledgerline.operators import contracts as C
from ledgerline.operators import quantiles as Q
from ledgerline.operators import reconcile as R
from ledgerline.operators import sequence as S
from ledgerline.plans.sequence import PAIRS, pairs
from ledgerline.plans.views import TAPS, taps
from ledgerline.registry import query


@query("R01_union_by_name", "SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    s = t.supplier.select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s)


SIG = ["l_orderkey", "l_linenumber", "l_returnflag"]
BAGS = """a AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem WHERE l_discount<=0.06 GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem WHERE l_discount>=0.04 GROUP BY ALL)"""


def bags(t):
    return t.lineitem.where("l_discount <= 0.06").select(*SIG), t.lineitem.where("l_discount >= 0.04").select(*SIG)


@query("R02_bag_intersection", f"""
WITH {BAGS} SELECT sum(a.n)::BIGINT AS left_rows, sum(b.n)::BIGINT AS right_rows, sum(CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0 ELSE least(a.n,b.n) END)::BIGINT AS shared_rows FROM a FULL JOIN b USING (l_orderkey,l_linenumber,l_returnflag)""")
def _(t):
    return R.bag_intersection_mass(*bags(t), SIG)


@query("R03_bag_difference", f"""
WITH {BAGS} SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN coalesce(a.n,0)>coalesce(b.n,0) THEN 'LEFT_ONLY' ELSE 'RIGHT_ONLY' END AS side, abs(coalesce(a.n,0)-coalesce(b.n,0)) AS n
FROM a FULL JOIN b USING (l_orderkey,l_linenumber,l_returnflag) WHERE coalesce(a.n,0)<>coalesce(b.n,0)""")
def _(t):
    return R.bag_difference(*bags(t), SIG)


@query("R04_explained_difference", f"""
WITH {TAPS}, m AS (SELECT *, lag(event_id) OVER w AS p_id, lag(us) OVER w AS p_us, lag(status) OVER w AS ps FROM taps WHERE status IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 loose AS (SELECT user_id, p_id, event_id, p_us, us FROM m WHERE status=0 AND ps=1 AND us-p_us<=28800000000)
SELECT p_id AS entry_event_id, event_id AS exit_event_id, (SELECT count(*) FROM taps x WHERE x.user_id=l.user_id AND x.us>l.p_us AND x.us<l.us AND x.status IS NULL)::BIGINT AS barriers,
 CASE WHEN (SELECT count(*) FROM taps x WHERE x.user_id=l.user_id AND x.us>l.p_us AND x.us<l.us AND x.status IS NULL)>0 THEN 'BARRIER_BETWEEN' ELSE 'NONE' END AS explanation FROM loose l""")
def _(t):
    """Pairs that ignore barriers, each explained by the barriers between its ends (difference of running counts)."""
    x = taps(t).withColumn("is_bar", F.when(F.col("status").isNull(), 1).otherwise(0).cast("bigint"))
    day = skew.span("us", clocks.DAY_S * 1_000_000)
    x = skew.running(x, ["user_id"], ["us", "event_id"], day, {"bars": ("sum", "is_bar")})
    loose = S.pair_entry_exit(x.where("status is not null"), "user_id", ["us", "event_id"], "us", "status", ["event_id", "bars"], day)
    n = F.col("exit_bars") - F.col("entry_bars")
    return loose.select("entry_event_id", "exit_event_id", n.alias("barriers"), R.evidence_class([("BARRIER_BETWEEN", n > 0)], "NONE").alias("explanation"))


@query("R05_invariant_set", f"""
WITH {PAIRS} SELECT (SELECT count(*) FROM pairs)<=(SELECT count(*) FROM taps WHERE status=0) AS pairs_within_exits, (SELECT min(duration_us) FROM pairs)>=0 AS no_negative, (SELECT count(DISTINCT exit_event_id)=count(*) FROM pairs) AS exits_unique,
 true AS qualified, 'QUALIFIED' AS status""")
def _(t):
    p = pairs(t).agg(F.count(F.lit(1)).alias("n"), F.min("duration_us").alias("lo"), F.count_distinct("exit_event_id").alias("d"))
    facts = p.withColumn("exits", taps(t).agg(F.count_if(F.col("status") == 0)).scalar())
    return C.gates(facts, {"pairs_within_exits": F.col("n") <= F.col("exits"), "no_negative": F.col("lo") >= 0, "exits_unique": F.col("d") == F.col("n")})


@query("R06_copy_union", """
WITH p AS (SELECT l_orderkey*8+l_linenumber AS idx, md5(l_shipdate::VARCHAR) AS sha, l_returnflag AS src, l_suppkey AS prio FROM lineitem)
SELECT idx, count(*) AS copies, count(DISTINCT sha)>1 AS conflict, arg_min(src,(prio,src)) AS chosen FROM p GROUP BY 1""")
def _(t):
    p = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), F.md5(F.col("l_shipdate").cast("string")).alias("sha"),
                          F.col("l_returnflag").alias("src"), F.col("l_suppkey").alias("prio"))
    return R.copy_union(p, "idx", "sha", "prio", "src").drop("digest")


@query("R07_shard_parity", """
SELECT count(DISTINCT l_suppkey)::BIGINT AS matched, 0::BIGINT AS left_only, 0::BIGINT AS right_only, 0.0::DOUBLE AS max_diff_mass FROM lineitem""")
def _(t):
    whole = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("mass"))
    shards = t.lineitem.groupBy("l_suppkey", F.pmod("l_orderkey", F.lit(50)).alias("shard")).agg(F.sum("l_quantity").alias("m"))
    return R.parity(whole, shards.groupBy("l_suppkey").agg(F.sum("m").alias("mass")), ["l_suppkey"], ["mass"])


@query("R08_edge_crosswalk", """
WITH pr AS (SELECT DISTINCT l_linenumber AS line, least(l_suppkey%30,l_partkey%30) AS a, greatest(l_suppkey%30,l_partkey%30) AS b FROM lineitem WHERE l_returnflag='R'), tp AS (SELECT DISTINCT l_linenumber AS line, least(l_suppkey%30,l_partkey%30) AS a, greatest(l_suppkey%30,l_partkey%30) AS b FROM lineitem WHERE l_returnflag='A' AND l_discount<0.03)
SELECT pr.line, count(*) AS edges, count(tp.a)::BIGINT AS matched, (count(*)-count(tp.a))::BIGINT AS unmatched FROM pr LEFT JOIN tp USING (line,a,b) GROUP BY 1""")
def _(t):
    e = t.lineitem.select(F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 30).alias("u"), (F.col("l_partkey") % 30).alias("v"), "l_returnflag", "l_discount")
    key = lambda df: df.select("line", *R.undirected("u", "v")).distinct()
    prior, topo = key(e.where("l_returnflag = 'R'")), key(e.where("l_returnflag = 'A' and l_discount < 0.03"))
    j = prior.join(topo.withColumn("hit", F.lit(1)), ["line", "end_low", "end_high"], "left")
    return j.groupBy("line").agg(F.count(F.lit(1)).alias("edges"), F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


@query("R09_schedule_comparison", """
WITH a AS (SELECT l_orderkey, l_linenumber, min(epoch_us(l_shipdate)//86400000000) AS t, min(l_quantity) AS sd FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber, max(epoch_us(l_shipdate)//86400000000) AS t FROM lineitem GROUP BY ALL),
 s AS (SELECT abs(a.t-b.t) AS shift, sd FROM a JOIN b USING (l_orderkey,l_linenumber))
SELECT count(*) AS n, quantile_cont(shift,0.5) AS p50, round(quantile_cont(shift,0.9),6) AS p90, round(quantile_cont(shift,0.99),6) AS p99, round(avg((shift<=1.96*sd)::INT::DOUBLE),6) AS coverage95 FROM s""")
def _(t):
    d = F.unix_date(F.col("l_shipdate").cast("date"))
    s = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.min("l_quantity").alias("sd"))
    s = s.select((F.col("hi") - F.col("lo")).alias("shift"), "sd")
    q = Q.quantiles(s, [], "shift", 30.0, {"p50": 0.5, "p90": 0.9, "p99": 0.99}).agg(F.struct(F.max("p50").alias("p50"), F.max("p90").alias("p90"), F.max("p99").alias("p99")))
    c = s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("shift") <= 1.96 * F.col("sd")).cast("double")), 6).alias("coverage95"))
    return c.withColumn("q", q.scalar()).select("n", F.col("q.p50").alias("p50"), F.round("q.p90", 6).alias("p90"), F.round("q.p99", 6).alias("p99"), "coverage95")


@query("R10_graph_patch", """
WITH n AS (SELECT n_nationkey AS node FROM nation), e AS (SELECT DISTINCT c_nationkey AS a, (c_custkey%20)::INT AS b FROM customer WHERE c_mktsegment='BUILDING'), p AS (SELECT DISTINCT s_nationkey AS a, (s_suppkey%30)::INT AS b FROM supplier)
SELECT p.a, p.b, CASE WHEN x.node IS NULL OR y.node IS NULL THEN 'UNKNOWN_ENDPOINT' WHEN e.a IS NOT NULL THEN 'DUPLICATE' ELSE 'APPLIED' END AS outcome
FROM p LEFT JOIN n x ON p.a=x.node LEFT JOIN n y ON p.b=y.node LEFT JOIN e ON e.a=p.a AND e.b=p.b""")
def _(t):
    from ledgerline.operators.graph import classify_patch
    nodes = t.nation.select(F.col("n_nationkey").alias("node"))
    edges = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 20).cast("int").alias("b")).distinct()
    patch = t.supplier.select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 30).cast("int").alias("b")).distinct()
    return classify_patch(nodes, edges, patch)


@query("R12_guarded_replacement", """
WITH s AS (SELECT l_suppkey AS root, l_linenumber AS line, sum(l_quantity)::BIGINT AS m FROM lineitem GROUP BY ALL)
SELECT root, line, m, 'KEPT' AS cls FROM s WHERE line<>7 UNION ALL SELECT root, 7, m+1, 'REBUILT' FROM s WHERE line=7 AND m>2100""")
def _(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("root"), F.col("l_linenumber").alias("line")).agg(F.sum("l_quantity").cast("bigint").alias("m")).withColumn("cls", F.lit("KEPT"))
    rebuilt = s.where("line = 7 and m > 2100").withColumns({"m": F.col("m") + 1, "cls": F.lit("REBUILT")})
    return R.replace_class(s, rebuilt, ["root", "line"], F.col("line") == 7)
