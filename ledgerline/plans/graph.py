"""Graph and route queries.

Suppliers are read as stops: line = key / 10, position = key % 10, station = nation.
Order lines are read as trips over stations and lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.operators import graph as N
from ledgerline.operators import quantiles as Q
from ledgerline.plans.views import RIDERS, RIDES, riders, rides
from ledgerline.registry import query, staged
from ledgerline.session import cut_lineage

CHAIN = """ed AS (SELECT c_custkey AS a, c_custkey+1 AS b, 'near' AS kind FROM customer WHERE c_custkey%5<>4 AND c_custkey+1 IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, (c_custkey*31)%(SELECT count(*) FROM customer), 'far' FROM customer WHERE c_custkey%20=0)"""
CC = f"""{CHAIN}, bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach AS (WITH RECURSIVE r(node, lab) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT bo.b, r.lab FROM r JOIN bo ON bo.a=r.node) SELECT node, min(lab) AS component FROM r GROUP BY 1)"""


def chain_edges(t):
    c = t.customer.select("c_custkey")
    n = c.agg(F.count(F.lit(1)))
    near = c.where("c_custkey % 5 <> 4").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b")).join(c.select(F.col("c_custkey").alias("b")), "b", "left_semi")
    far = c.where("c_custkey % 20 = 0").withColumn("n", n.scalar()).select(F.col("c_custkey").alias("a"), (F.col("c_custkey") * 31 % F.col("n")).alias("b"))
    return near.select("a", "b", F.lit("near").alias("kind")).unionByName(far.withColumn("kind", F.lit("far")))


@staged
def components(t):
    return N.connected_components(t.customer.select(F.col("c_custkey").alias("node")), chain_edges(t))


@query("N01_connected_components", f"WITH {CC} SELECT node, component FROM reach")
def _(t):
    return components(t)


ODC = "oc AS (SELECT o_custkey AS origin, (o_custkey + 1 + o_orderkey%3) % (SELECT count(*) FROM customer) AS destination, count(*) AS mass FROM orders GROUP BY ALL)"


def od_customers(t):
    n = t.customer.agg(F.count(F.lit(1)))
    x = t.orders.withColumn("n", n.scalar())
    return x.groupBy(F.col("o_custkey").alias("origin"), ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 3) % F.col("n")).alias("destination")).agg(F.count(F.lit(1)).alias("mass"))


def mode_sql(edges: str, comp: str) -> str:
    return f"""SELECT origin, destination, mass, CASE WHEN e.a IS NOT NULL THEN 'DIRECT' WHEN x.component=y.component THEN 'TRANSITIVE' ELSE 'UNREACHABLE' END AS mode
FROM oc LEFT JOIN (SELECT DISTINCT a, b FROM {edges}) e ON e.a=origin AND e.b=destination LEFT JOIN {comp} x ON x.node=origin LEFT JOIN {comp} y ON y.node=destination"""


@query("N02_reachability_audit", f"WITH {CC}, {ODC} {mode_sql('bo', 'reach')}")
def _(t):
    return N.reachable_mass(od_customers(t), "origin", "destination", "mass", components(t), chain_edges(t))


NET = """st AS (SELECT s_suppkey AS node, s_suppkey//10 AS line, s_suppkey%10 AS seq, s_nationkey AS station FROM supplier),
 e1 AS (SELECT x.node AS a, y.node AS b, 'ride' AS kind FROM st x JOIN st y ON x.line=y.line AND y.seq=x.seq+1 UNION ALL SELECT node, -1-station, 'transfer' FROM st),
 net AS (SELECT * FROM e1 UNION ALL SELECT b, a, kind FROM e1)"""


def stops(t):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("node"), F.floor(k / 10).alias("line"), (k % 10).alias("seq"), F.col("s_nationkey").alias("station"))


def network(t):
    return N.line_network(stops(t), "node", "line", "seq", "station")


def hubs(t):
    return t.nation.select((-1 - F.col("n_nationkey")).cast("bigint").alias("source"))


@query("N03_line_network", f"WITH {NET} SELECT a, b, kind FROM net")
def _(t):
    return network(t)


POLICY = """pol AS (SELECT 'balanced' AS policy, 3.0::DOUBLE AS tw UNION ALL SELECT 'few_changes', 9.0)"""
SSSP = f"""{NET}, {POLICY}, we AS (SELECT policy, a, b, CASE WHEN kind='ride' THEN 2.0+(least(a,b)%3) ELSE tw END AS cost FROM net, pol),
 bf AS (WITH RECURSIVE r(policy, source, node, cost, k) AS (SELECT policy, -1-n_nationkey, -1-n_nationkey, 0.0::DOUBLE, 0 FROM nation, pol UNION ALL SELECT r.policy, r.source, we.b, min(r.cost+we.cost), any_value(r.k)+1 FROM r JOIN we ON we.policy=r.policy AND we.a=r.node WHERE r.k<24 GROUP BY 1,2,3) SELECT policy, source, node, min(cost) AS cost FROM r GROUP BY 1,2,3)"""


def weighted(t):
    n = network(t)
    ride = F.lit(2.0) + F.least("a", "b") % 3
    out = None
    for policy, tw in (("balanced", 3.0), ("few_changes", 9.0)):
        e = n.select(F.lit(policy).alias("policy"), "a", "b", F.when(F.col("kind") == "ride", ride).otherwise(F.lit(tw)).alias("cost"))
        out = e if out is None else out.unionByName(e)
    return out


@staged
def policy_paths(t):
    src = hubs(t)
    both = src.withColumn("policy", F.explode(F.array(F.lit("balanced"), F.lit("few_changes"))))
    return N.shortest_paths(weighted(t), both, ["policy"])


@query("N04_shortest_paths", f"WITH {SSSP} SELECT policy, source, node, cost FROM bf")
def _(t):
    return policy_paths(t).select("policy", "source", "node", "cost")


@query("N05_route_alternatives")
def _(t):
    """Routes ranked over policies; costs and sets are checked in the tests."""
    r = N.route_alternatives(policy_paths(t), "policy")
    return r.select("source", "node", "cost", F.array_join("policies", "|").alias("policies"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("route"), "route_rank")


@query("N06_k_shortest_simple_paths", f"""
WITH {SSSP}, pr AS (SELECT source, node AS target, greatest(cost*1.3::DOUBLE, cost+2) AS cap FROM bf WHERE policy='balanced' AND node<0 AND source<>node),
 sp AS (WITH RECURSIVE r(source,target,cap,here,cost,path) AS (SELECT source,target,cap,source,0.0::DOUBLE,[source] FROM pr UNION ALL SELECT r.source, r.target, r.cap, we.b, r.cost+we.cost, list_append(r.path, we.b) FROM r JOIN we ON we.policy='balanced' AND we.a=r.here JOIN bf ON bf.policy='balanced' AND bf.source=r.target AND bf.node=we.b
   WHERE r.here<>r.target AND NOT list_contains(r.path, we.b) AND r.cost+we.cost+bf.cost<=r.cap) SELECT * FROM r WHERE here=target)
SELECT source, target, row_number() OVER w::INT AS route_rank, cost, array_to_string(path,'>') AS route, count(*) OVER (PARTITION BY source, target)>4 AS truncated FROM sp WINDOW w AS (PARTITION BY source, target ORDER BY cost, path) QUALIFY row_number() OVER w<=4""".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))
def _(t):
    """Hub to hub routes within the detour bound."""
    e = weighted(t).where("policy = 'balanced'").drop("policy")
    best = cut_lineage(N.shortest_paths(e, hubs(t)).select("source", "node", "cost"))
    pairs = best.where("node < 0 and source <> node").select("source", F.col("node").alias("target"))
    k = N.simple_paths(e, pairs, best, 4, 1.3, 2.0)
    return k.select("source", "target", "route_rank", "cost", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("route"), "truncated")


WALK = f"""{NET}, ee AS (SELECT a, b, (kind='ride')::BIGINT AS dr, (kind='transfer')::BIGINT AS dt, CASE WHEN kind='transfer' THEN 0.0 WHEN least(a,b)%7<>0 THEN 60.0+least(a,b)%11 END::DOUBLE AS m FROM net),
 wk AS (WITH RECURSIVE r(source,node,r,c,paths,covered,lo,hi,k) AS (SELECT -1-n_nationkey,-1-n_nationkey,0::BIGINT,0::BIGINT,1::DOUBLE,1::DOUBLE,0.0::DOUBLE,0.0::DOUBLE,0 FROM nation UNION ALL
   SELECT r.source, ee.b, r.r+ee.dr, r.c+ee.dt, sum(r.paths), sum(CASE WHEN ee.m IS NULL THEN 0 ELSE r.covered END), min(r.lo+ee.m), max(r.hi+ee.m), any_value(r.k)+1 FROM r JOIN ee ON ee.a=r.node WHERE r.k<18 GROUP BY 1,2,3,4) SELECT source,node,r,c,sum(paths) AS paths,sum(covered) AS covered,min(lo) AS lo,max(hi) AS hi FROM r GROUP BY 1,2,3,4),
 fr AS (SELECT * FROM wk w WHERE NOT EXISTS (SELECT 1 FROM wk v WHERE v.source=w.source AND v.node=w.node AND v.r<=w.r AND v.c<=w.c AND (v.r<w.r OR v.c<w.c)))"""


@staged
def frontier(t):
    e = network(t).select("a", "b", (F.col("kind") == "ride").cast("bigint").alias("dr"), (F.col("kind") == "transfer").cast("bigint").alias("dt"),
                          F.when(F.col("kind") == "transfer", F.lit(0.0)).when(F.pmod(F.least("a", "b"), F.lit(7)) != 0, F.lit(60.0) + F.least("a", "b") % 11).alias("m"))
    return N.frontier(cut_lineage(e), hubs(t), ["m"])


@query("N07_pareto_frontier", f"WITH {WALK} SELECT source, node, r, c, paths::BIGINT AS paths FROM fr")
def _(t):
    return frontier(t)[0].select("source", "node", "r", "c", "paths")


@query("N08_tied_paths", f"WITH {WALK} SELECT source, node AS target, r AS tr, c AS tc, paths::BIGINT AS distinct_paths FROM fr WHERE node<0")
def _(t):
    labels, parents = frontier(t)
    p = N.tied_paths(labels, parents, hubs(t).select(F.col("source").alias("node")))
    return p.groupBy("source", "target", "tr", "tc").agg(F.count_distinct("path").alias("distinct_paths"))


@query("N09_tied_metric_bounds", f"WITH {WALK} SELECT source, node, r, c, covered::BIGINT AS covered, CASE WHEN covered>0 THEN lo END AS lo, CASE WHEN covered>0 THEN hi END AS hi, (paths>1 AND covered=paths AND lo=hi) AS equivalent FROM fr")
def _(t):
    x = frontier(t)[0]
    eq = (F.col("paths") > 1) & (F.col("covered") == F.col("paths")) & (F.col("m_lo") == F.col("m_hi"))
    return x.select("source", "node", "r", "c", "covered", F.col("m_lo").alias("lo"), F.col("m_hi").alias("hi"), F.coalesce(eq, F.lit(False)).alias("equivalent"))


TRIP = """tr AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_suppkey%3)::BIGINT AS line, min(l_suppkey%25)::BIGINT AS station, min(l_quantity) AS q FROM lineitem GROUP BY 1,2)"""


def trips(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq")).agg(
        F.min(F.col("l_suppkey") % 3).alias("line"), F.min(F.col("l_suppkey") % 25).alias("station"), F.min("l_quantity").alias("q"))


STEP = f"{TRIP}, sp AS (SELECT *, lead(line) OVER w AS nl, lead(station) OVER w AS ns FROM tr WINDOW w AS (PARTITION BY trip ORDER BY seq))"


@query("N10_path_metric_sum", f"""
WITH {STEP}, pr AS (SELECT (l_suppkey%3)::BIGINT AS line, least(l_suppkey%25,l_partkey%25)::BIGINT AS low, greatest(l_suppkey%25,l_partkey%25)::BIGINT AS high, CASE WHEN count_if(l_returnflag='R')*4<count(*) THEN avg(l_quantity) END AS med FROM lineitem GROUP BY ALL),
 ed AS (SELECT trip, line, least(station,ns) AS low, greatest(station,ns) AS high FROM sp WHERE nl=line AND ns<>station), g AS (SELECT trip, count(*) AS n, count_if(med IS NULL) AS miss, sum(med) AS s FROM ed LEFT JOIN pr USING (line,low,high) GROUP BY 1),
 ch AS (SELECT trip, count_if(nl<>line)::BIGINT AS changes FROM sp WHERE nl IS NOT NULL GROUP BY 1)
SELECT trip, changes, coalesce(n,0)::BIGINT AS ride_edges, coalesce(miss,0)::BIGINT AS missing, round(CASE WHEN coalesce(miss,0)=0 THEN coalesce(s,0.0) END,6) AS med FROM ch LEFT JOIN g USING (trip)""")
def _(t):
    u, v = F.col("l_suppkey") % 25, F.col("l_partkey") % 25
    # a cell has a prior if fewer than a quarter of its rows came back
    kept = F.count_if(F.col("l_returnflag") == "R") * 4 < F.count(F.lit(1))
    prior = t.lineitem.groupBy((F.col("l_suppkey") % 3).alias("line"), F.least(u, v).alias("low"), F.greatest(u, v).alias("high")).agg(F.when(kept, F.avg("l_quantity")).alias("med"))
    return N.path_metric(trips(t), ["trip"], "seq", "station", "line", None, prior, "med").withColumn("med", F.round("med", 6))


LEGS = f"{TRIP}, lg0 AS (SELECT *, CASE WHEN line=lag(line) OVER w THEN 0 ELSE 1 END AS nw FROM tr WINDOW w AS (PARTITION BY trip ORDER BY seq)), lg1 AS (SELECT *, sum(nw) OVER (PARTITION BY trip ORDER BY seq) AS leg_no FROM lg0), lg AS (SELECT trip, leg_no::BIGINT AS leg_no, line, arg_min(station,seq) AS from_node, arg_max(station,seq) AS to_node, min(seq) AS first_seq, max(seq) AS last_seq FROM lg1 GROUP BY ALL)"


def trip_legs(t):
    return N.legs(trips(t), ["trip"], "seq", "station", "line", None)


@query("N11_legs_from_path", f"WITH {LEGS} SELECT * FROM lg")
def _(t):
    return trip_legs(t)


@query("N12_leg_options", """
WITH p AS (SELECT l_orderkey AS leg, l_linenumber AS edge, l_suppkey%4 AS opt, min(l_quantity) AS run FROM lineitem GROUP BY ALL), n AS (SELECT leg, count(DISTINCT edge) AS n FROM p GROUP BY 1)
SELECT leg, opt, sum(run) AS run FROM p JOIN n USING (leg) GROUP BY leg, opt, n HAVING count(*)=n""")
def _(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("leg"), F.col("l_linenumber").alias("edge"), (F.col("l_suppkey") % 4).alias("opt"), F.col("l_quantity").alias("run"))
    return N.leg_options(e, ["leg"], ["edge"], "opt", "run")


WORLD = f"""{NET}, w AS (SELECT 'paid' AS world, a, b, kind FROM net UNION ALL SELECT 'virtual', a, b, kind FROM net WHERE NOT (kind='transfer' AND least(a,b)%2=0))"""


def worlds(t):
    n = network(t)
    keep = ~((F.col("kind") == "transfer") & (F.pmod(F.least("a", "b"), F.lit(2)) == 0))
    return n.withColumn("world", F.lit("paid")).unionByName(n.where(keep).withColumn("world", F.lit("virtual")))


@query("N13_topology_worlds", f"WITH {WORLD} SELECT world, kind, count(*) AS edges, count(DISTINCT a) AS nodes FROM w GROUP BY ALL")
def _(t):
    return worlds(t).groupBy("world", "kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("a").alias("nodes"))


@query("N14_route_clear_selection", """
WITH v AS (SELECT o_custkey AS od, o_orderstatus AS world, count(*) AS paths, min(o_orderpriority) AS rep, max(o_orderpriority) AS rep2, bool_or(o_totalprice<20000) AS missing FROM orders GROUP BY ALL)
SELECT od, min(rep) AS route FROM v GROUP BY 1 HAVING count(*)>=2 AND bool_and(rep=rep2) AND count(DISTINCT rep)=1 AND NOT bool_or(missing)""")
def _(t):
    v = t.orders.groupBy(F.col("o_custkey").alias("od"), F.col("o_orderstatus").alias("world")).agg(
        F.min("o_orderpriority").alias("rep"), F.max("o_orderpriority").alias("rep2"), F.bool_or(F.col("o_totalprice") < 20000).alias("missing"))
    g = v.groupBy("od").agg(F.count(F.lit(1)).alias("worlds"), F.bool_and(F.col("rep") == F.col("rep2")).alias("single"), F.min("rep").alias("route"), F.max("rep").alias("top"), F.bool_or("missing").alias("missing"))
    return g.where("worlds >= 2 and single and route = top and not missing").select("od", "route")


@query("N15_od_family", f"""
WITH {RIDERS}, f AS (SELECT DISTINCT CASE WHEN from_station<8 AND to_station<8 THEN 'TRUNK' WHEN from_station<8 OR to_station<8 THEN 'TRUNK_BRANCH' WHEN from_station%2=to_station%2 THEN 'SAME_BRANCH' ELSE 'CROSS_BRANCH' END AS family, from_station, to_station FROM riders) SELECT * FROM f""")
def _(t):
    o, d = F.col("from_station") < 8, F.col("to_station") < 8
    fam = F.when(o & d, "TRUNK").when(o | d, "TRUNK_BRANCH").when(F.col("from_station") % 2 == F.col("to_station") % 2, "SAME_BRANCH").otherwise("CROSS_BRANCH")
    return riders(t).select("from_station", "to_station").distinct().withColumn("family", fam)


@query("N16_slice_classification", f"""
WITH {LEGS}, g AS (SELECT trip, count(*) AS legs, max(last_seq-first_seq) AS longest FROM lg GROUP BY 1)
SELECT trip, CASE WHEN legs>3 THEN 'UNRESOLVED:TRANSFERS' WHEN longest=0 THEN 'UNRESOLVED:NO_RIDE' WHEN legs=1 THEN 'CLEAR' ELSE 'PHASE_DEPENDENT' END AS class FROM g""")
def _(t):
    g = trip_legs(t).groupBy("trip").agg(F.count(F.lit(1)).alias("legs"), F.max(F.col("last_seq") - F.col("first_seq")).alias("longest"))
    return g.select("trip", F.when(F.col("legs") > 3, "UNRESOLVED:TRANSFERS").when(F.col("longest") == 0, "UNRESOLVED:NO_RIDE").when(F.col("legs") == 1, "CLEAR").otherwise("PHASE_DEPENDENT").alias("class"))


@query("N17_movement_authority", f"""
WITH {LEGS}, m AS (SELECT trip, line AS from_line, lead(line) OVER w AS to_line, to_node AS station FROM lg WINDOW w AS (PARTITION BY trip ORDER BY leg_no)) SELECT station, from_line, to_line, count(*) AS trips FROM m WHERE to_line IS NOT NULL GROUP BY ALL""")
def _(t):
    x = skew.neighbour(trip_legs(t), ["trip"], ["leg_no"], None, ["line"], "nx", following=True).where("nx is not null")
    return x.groupBy(F.col("to_node").alias("station"), F.col("line").alias("from_line"), F.col("nx.line").alias("to_line")).agg(F.count(F.lit(1)).alias("trips"))


FRAG = f"""{CC}, fs AS (SELECT c_custkey%50 AS line, c_custkey//50 AS seq, component, c_mktsegment, c_nationkey FROM customer JOIN reach ON node=c_custkey)"""


def fragments(t):
    k = F.col("c_custkey")
    return t.customer.join(components(t), k == F.col("node")).select((k % 50).alias("line"), F.floor(k / 50).alias("seq"), "component", "c_mktsegment", "c_nationkey", k.alias("cust"))


@query("N18_fragment_gaps", f"""
WITH {FRAG}, f AS (SELECT line, component, min(seq) AS lo, max(seq) AS hi, count(*) AS stops FROM fs GROUP BY ALL), x AS (SELECT line, component AS component_a, lead(component) OVER w AS component_b, lead(lo) OVER w - hi AS gap, stops, lead(stops) OVER w AS next_stops FROM f WINDOW w AS (PARTITION BY line ORDER BY lo, component))
SELECT * FROM x WHERE component_b IS NOT NULL""")
def _(t):
    return N.fragment_gaps(fragments(t), "line", "seq", "component")


@query("N19_bridge_evidence", f"""
WITH {FRAG}, n AS (SELECT DISTINCT line//10 AS line, component%20 AS component, c_nationkey::VARCHAR AS code, c_mktsegment||(c_nationkey%5)::VARCHAR AS nm FROM fs),
 r AS (SELECT DISTINCT 'code' AS kind, code AS key, 4 AS strength, component, line FROM n UNION SELECT DISTINCT 'name', nm, 2, component, line FROM n)
SELECT a.component AS ca, b.component AS cb, max(a.strength)::INT AS strength, count(DISTINCT a.kind) AS kinds, count(DISTINCT (a.kind,a.key)) AS keys FROM r a JOIN r b ON a.kind=b.kind AND a.key=b.key AND a.component<b.component AND a.line<>b.line GROUP BY 1,2""")
def _(t):
    n = fragments(t).select(F.floor(F.col("line") / 10).alias("line"), (F.col("component") % 20).alias("component"), F.col("c_nationkey").alias("code"),
                            F.concat("c_mktsegment", (F.col("c_nationkey") % 5).cast("string")).alias("nm"))
    return N.bridge_evidence(n, {"code": ("code", 4), "name": ("nm", 2)}, "component", "line")


@query("N20_terminal_corridors", f"""
WITH {NET}, rd AS (SELECT a, b FROM net WHERE kind='ride'), tm AS (SELECT a AS node FROM rd GROUP BY 1 HAVING count(DISTINCT b)=1),
 w AS (WITH RECURSIVE r(source,node,k) AS (SELECT node,node,0 FROM tm UNION SELECT r.source, rd.b, r.k+1 FROM r JOIN rd ON rd.a=r.node WHERE r.k<12) SELECT source,node,min(k) AS k FROM r GROUP BY 1,2)
SELECT source, node, k::DOUBLE AS cost FROM w JOIN tm USING (node) WHERE source<>node""")
def _(t):
    e = cut_lineage(network(t).where("kind = 'ride'").select("a", "b", F.lit(1.0).alias("cost")))
    tm = N.terminals(e)
    p = N.shortest_paths(e, tm.select(F.col("node").alias("source")))
    return p.join(tm, "node", "left_semi").where("source <> node").select("source", "node", "cost")


@query("N21_missing_segment_class", f"""
WITH {RIDES}, {RIDERS}, want AS (SELECT DISTINCT (from_station+to_station)%6 AS line, from_station AS o, to_station AS d FROM riders), var AS (SELECT DISTINCT line, from_station%5 AS root, from_station AS f, to_station AS t, sign(to_station-from_station) AS s FROM rides),
 flags AS (SELECT w.line, o, d, root, bool_or(s=sign(d-o) AND f=o AND t=d) AS exact, bool_or(s<>sign(d-o) AND o IN (f,t) AND d IN (f,t)) AS opposite, bool_or(s=sign(d-o) AND o IN (f,t)) AND bool_or(s=sign(d-o) AND d IN (f,t)) AS variant,
  bool_or(s=sign(d-o) AND least(f,t)<=least(o,d) AND greatest(o,d)<=greatest(f,t)) AS interior, bool_or(s=sign(d-o) AND least(abs(f-o),abs(f-d),abs(t-o),abs(t-d))<=1) AS near FROM want w JOIN var ON var.line=w.line GROUP BY ALL),
 any_ AS (SELECT line, o, d, bool_or(exact) AS e, bool_or(variant) AS v, bool_or(interior) AS i, bool_or(near) AS n, bool_or(opposite) AS p FROM flags GROUP BY ALL)
SELECT w.line, w.o, w.d, CASE WHEN e THEN 'EXACT' WHEN v THEN 'VARIANT' WHEN i THEN 'INTERIOR' WHEN n THEN 'NEAR' WHEN p THEN 'OPPOSITE' ELSE 'NONE' END AS class FROM want w LEFT JOIN any_ USING (line, o, d)""")
def _(t):
    want = riders(t).select(F.pmod(F.col("from_station") + F.col("to_station"), F.lit(6)).alias("line"), F.col("from_station").alias("o"), F.col("to_station").alias("d")).distinct()
    variants = rides(t).select("line", (F.col("from_station") % 5).alias("root"), F.col("from_station").alias("f"), F.col("to_station").alias("t")).distinct()
    return N.segment_classes(want, variants, "line", "root", 1)


@query("R11_before_after_reroute", f"""
WITH {CHAIN}, {ODC}, base AS (SELECT * FROM ed WHERE kind='near'), b1 AS (SELECT a,b FROM base UNION SELECT b,a FROM base), b2 AS (SELECT a,b FROM ed UNION SELECT b,a FROM ed),
 c1 AS (WITH RECURSIVE r(node, lab) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT b1.b, r.lab FROM r JOIN b1 ON b1.a=r.node) SELECT node, min(lab) AS component FROM r GROUP BY 1),
 c2 AS (WITH RECURSIVE r(node, lab) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT b2.b, r.lab FROM r JOIN b2 ON b2.a=r.node) SELECT node, min(lab) AS component FROM r GROUP BY 1),
 m1 AS ({mode_sql('b1', 'c1')}), m2 AS ({mode_sql('b2', 'c2')})
SELECT m1.mode AS before_mode, m2.mode AS after_mode, sum(m1.mass)::BIGINT AS mass, count(*) AS od_pairs FROM m1 JOIN m2 USING (origin, destination) GROUP BY 1,2""")
def _(t):
    nodes, edges = t.customer.select(F.col("c_custkey").alias("node")), cut_lineage(chain_edges(t))
    near, far = edges.where("kind = 'near'").select("a", "b"), edges.where("kind = 'far'").select("a", "b")
    c = cut_lineage(N.joined_components(cut_lineage(N.connected_components(nodes, near)), far))
    end = lambda side: c.select(F.col("node").alias(side), F.col("component").alias(f"{side}_before"), F.col("joined").alias(f"{side}_after"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
    direct = both.groupBy(F.col("a").alias("origin"), F.col("b").alias("destination")).agg(F.bool_or(F.col("kind") == "near").alias("near"))
    x = od_customers(t).where("origin is not null and destination is not null").join(end("origin"), "origin", "left").join(end("destination"), "destination", "left").join(direct, ["origin", "destination"], "left")
    mode = lambda edge, when: F.when(edge, "DIRECT").when(F.col(f"origin_{when}") == F.col(f"destination_{when}"), "TRANSITIVE").otherwise("UNREACHABLE")
    return x.groupBy(mode(F.col("near"), "before").alias("before_mode"), mode(F.col("near").isNotNull(), "after").alias("after_mode")).agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("od_pairs"))


@query("W26_bracketed_prediction", """
WITH ev AS (SELECT l_orderkey AS trip, l_suppkey AS node, min(epoch_us(l_shipdate)//86400000000) AS t FROM lineitem GROUP BY 1,2), nb AS (SELECT *, lead(node) OVER w AS nn, lead(t) OVER w AS nt FROM ev WINDOW w AS (PARTITION BY trip ORDER BY t, node)),
 br AS (SELECT trip, unnest(range(least(node,nn)+1, greatest(node,nn))) AS mid, node, nn, t, nt FROM nb WHERE nn IS NOT NULL AND node//10=nn//10),
 al AS (SELECT trip, mid AS node, t+(nt-t)*(abs(mid-node)/abs(nn-node)::DOUBLE) AS at_, nt-t AS slack, false AS exact FROM br UNION ALL SELECT trip, node, t, 0, true FROM ev)
SELECT trip, node, round(arg_min(at_,(NOT exact, slack, at_)),6) AS at_day, bool_or(exact) AS exact FROM al GROUP BY 1,2""")
def _(t):
    from ledgerline.operators.sequence import bracketed_times
    ride = cut_lineage(network(t).where("kind = 'ride'").select("a", "b", F.lit(1).cast("bigint").alias("dr"), F.lit(0).cast("bigint").alias("dt")))
    labels, _ = N.frontier(ride, stops(t).select(F.col("node").alias("source")))
    only = labels.where("paths = 1 and r > 1").select("source", F.col("node").alias("target"), F.col("r").alias("length"), F.posexplode("path").alias("pos", "node"))
    ev = t.lineitem.groupBy(F.col("l_orderkey").alias("trip"), F.col("l_suppkey").alias("node")).agg(F.min(F.unix_date(F.col("l_shipdate").cast("date"))).cast("bigint").alias("t"))
    return bracketed_times(ev, only, "trip", "node", "t", None).select("trip", "node", F.round("at", 6).alias("at_day"), "exact")
