"""Graph tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.session import cut_lineage


def component_pair_mass(od: DataFrame, components: DataFrame, origin: str, destination: str, mass: str) -> DataFrame:
    """Mass and OD pairs between different components; cells are combined before the lookups."""
    cells = od.groupBy(origin, destination).agg(F.sum(mass).alias("m"))
    a = components.select(F.col("node").alias(origin), F.col("component").alias("ca"))
    b = components.select(F.col("node").alias(destination), F.col("component").alias("cb"))
    j = cells.join(a, origin).join(b, destination).where("ca <> cb")
    return j.groupBy(F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high")).agg(
        F.sum("m").alias("mass"), F.count(F.lit(1)).alias("od_pairs"))


def classify_patch(nodes: DataFrame, edges: DataFrame, patch: DataFrame) -> DataFrame:
    """Outcome of each patch edge (a, b): applied, or refused for an unknown endpoint or an existing edge."""
    known = lambda c: nodes.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_known"))
    p = patch.join(known("a"), "a", "left").join(known("b"), "b", "left").join(edges.select("a", "b", F.lit(True).alias("dup")), ["a", "b"], "left")
    outcome = (F.when(F.col("a_known").isNull() | F.col("b_known").isNull(), "UNKNOWN_ENDPOINT").when(F.col("dup"), "DUPLICATE").otherwise("APPLIED"))
    return p.select("a", "b", outcome.alias("outcome"))


def apply_patch(nodes: DataFrame, edges: DataFrame, patch: DataFrame) -> DataFrame:
    added = classify_patch(nodes, edges, patch).where("outcome = 'APPLIED'").select("a", "b")
    return edges.select("a", "b").unionByName(added)


def greedy_independent(nodes: DataFrame, node: str, edges: DataFrame, rank: Sequence[Column]) -> DataFrame:
    """Greedy selection: by rank, keep a node when none of its kept neighbours ranks before it.

    ``edges`` lists conflicting pairs (a, b) once. Equal to the sequential pass: a node
    that outranks all its undecided neighbours is kept and they fall.
    """
    ranked = nodes.withColumn("__rank", F.struct(*rank))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    r = ranked.select(F.col(node).alias("b"), F.col("__rank").alias("rb"))
    open_edges = cut_lineage(both.join(r, "b").join(r.select(F.col("b").alias("a"), F.col("rb").alias("ra")), "a"))
    fallen = None
    while True:
        if open_edges.isEmpty():
            break
        # a node wins when no undecided neighbour ranks before it
        best = open_edges.groupBy("a").agg(F.min("rb").alias("best"), F.first("ra").alias("mine"))
        winners = best.where("mine < best").select("a")
        lost = cut_lineage(open_edges.join(winners, "a", "left_semi").select(F.col("b").alias("n")).distinct())
        fallen = lost if fallen is None else fallen.unionByName(lost)
        gone = lost.select(F.col("n").alias("a")).unionByName(winners)
        open_edges = cut_lineage(open_edges.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti"))
    if fallen is None:
        return nodes
    return nodes.join(fallen.select(F.col("n").alias(node)), node, "left_anti")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id of each node's component: alternating large-star and small-star rounds.

    A round hangs every neighbour on the smallest node it can see; the number of rounds
    grows with the logarithm of the longest chain. Minima are combined map-side, so a hub costs no more.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
        e = cut_lineage(small.select("p.u", "p.v").where("u <> v").distinct())
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return nodes.select("node").join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def joined_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component, joined``: components before and after the edges (a, b) are added, which may have ends that are no node.

    Only the new edges run rounds, between the components that they join; the smallest node of a component stays its label.
    """
    end = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
    x = edges.join(end("a"), "a", "left").join(end("b"), "b", "left")
    x = cut_lineage(x.select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b")).where("a <> b").distinct())
    ends = x.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    new = connected_components(ends, x).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return components.join(new, "component", "left").select("node", "component", F.coalesce("joined", "component").alias("joined"))


def reachable_mass(od: DataFrame, origin: str, destination: str, mass: str, components: DataFrame, direct: DataFrame) -> DataFrame:
    """OD cells labelled DIRECT, TRANSITIVE or UNREACHABLE."""
    cells = od.groupBy(origin, destination).agg(F.sum(mass).alias("mass"))
    a = components.select(F.col("node").alias(origin), F.col("component").alias("ca"))
    b = components.select(F.col("node").alias(destination), F.col("component").alias("cb"))
    d = direct.select(F.col("a").alias(origin), F.col("b").alias(destination), F.lit(True).alias("edge")).unionByName(
        direct.select(F.col("b").alias(origin), F.col("a").alias(destination), F.lit(True).alias("edge"))).distinct()
    j = cells.join(a, origin, "left").join(b, destination, "left").join(d, [origin, destination], "left")
    mode = F.when(F.col("edge"), "DIRECT").when(F.col("ca") == F.col("cb"), "TRANSITIVE").otherwise("UNREACHABLE")
    return j.select(origin, destination, "mass", mode.alias("mode"))


def line_network(stops: DataFrame, node: str, line: str, seq: str, station: str) -> DataFrame:
    """Directed edges (a, b, kind) both ways: rides between consecutive stops, transfers through a station hub.

    A hub (negative id) replaces the pairs of all nodes of one station: the edges stay
    linear in the nodes, a change of line is one step in and one step out.
    """
    nxt = stops.select(F.col(line), (F.col(seq) - 1).alias(seq), F.col(node).alias("b"))
    ride = stops.join(nxt, [line, seq]).select(F.col(node).alias("a"), "b", F.lit("ride").alias("kind"))
    hub = stops.select(F.col(node).alias("a"), (-1 - F.col(station)).cast("bigint").alias("b"), F.lit("transfer").alias("kind"))
    e = ride.unionByName(hub)
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))


def shortest_paths(edges: DataFrame, sources: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Cheapest path from each source to every node by rounds of relaxation; ties go to the smaller path.

    ``edges`` has (a, b, cost) and the group columns (such as a policy); only nodes
    improved in the last round are expanded.
    """
    start = sources.select(*group, "source", F.col("source").alias("node"), F.lit(0).cast("double").alias("cost"), F.array("source").alias("path"))
    best, front = cut_lineage(start), start
    while True:
        step = front.withColumnRenamed("node", "a").join(edges.select(*group, "a", "b", F.col("cost").alias("w")), [*group, "a"])
        cand = step.where(~F.array_contains("path", F.col("b"))).select(
            *group, "source", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("b")).alias("path"))
        cand = cand.groupBy(*group, "source", "node").agg(F.min(F.struct("cost", "path")).alias("c"))
        old = best.select(*group, "source", "node", F.struct("cost", "path").alias("o"))
        better = cut_lineage(cand.join(old, [*group, "source", "node"], "left").where("o is null or c < o").select(
            *group, "source", "node", F.col("c.cost").alias("cost"), F.col("c.path").alias("path")))
        if better.isEmpty():
            return best
        best = cut_lineage(best.join(better.select(*group, "source", "node"), [*group, "source", "node"], "left_anti").unionByName(better))
        front = better


def route_alternatives(paths: DataFrame, policy: str) -> DataFrame:
    """Distinct paths per OD over all policies with their policy sets, ranked by cost then path."""
    g = paths.groupBy("source", "node", "path").agg(F.min("cost").alias("cost"), F.array_sort(F.collect_set(policy)).alias("policies"))
    w = Window.partitionBy("source", "node").orderBy("cost", "path")
    return g.withColumn("route_rank", F.row_number().over(w))


def simple_paths(edges: DataFrame, pairs: DataFrame, best: DataFrame, k: int, ratio: float, extra: float) -> DataFrame:
    """k cheapest simple paths per (source, target) within the detour bound.

    The bound is max(ratio * best, best + extra). A partial path lives only while its
    cost plus the exact remaining distance stays within it, so the expansion finds all
    paths in the bound and nothing else. ``best`` has (source, node, cost) of an undirected network for
    every target as source. ``truncated`` tells that more than k paths qualify.
    """
    rest = best.select(F.col("source").alias("target"), F.col("node").alias("at"), F.col("cost").alias("left"))
    p = pairs.join(best.select("source", F.col("node").alias("target"), F.col("cost").alias("base")), ["source", "target"])
    p = p.withColumn("cap", F.greatest(F.col("base") * ratio, F.col("base") + extra))
    front = p.select("source", "target", "cap", F.col("source").alias("at"), F.lit(0.0).alias("cost"), F.array("source").alias("path"))
    done = None
    while True:
        step = front.withColumnRenamed("at", "a").join(edges.select("a", F.col("b").alias("at"), F.col("cost").alias("w")), "a")
        step = step.where(~F.array_contains("path", F.col("at"))).withColumn("cost", F.col("cost") + F.col("w"))
        step = step.join(rest, ["target", "at"]).where(F.col("cost") + F.col("left") <= F.col("cap"))
        step = cut_lineage(step.select("source", "target", "cap", "at", "cost", F.concat("path", F.array("at")).alias("path")))
        arrived = step.where("at = target").select("source", "target", "cost", "path")
        done = arrived if done is None else done.unionByName(arrived)
        front = step.where("at <> target")
        if front.isEmpty():
            break
    n = done.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "target").orderBy("cost", "path")
    return (done.withColumn("route_rank", F.row_number().over(w)).where(F.col("route_rank") <= k)
            .join(n, ["source", "target"]).withColumn("truncated", F.col("n") > k).drop("n"))


def frontier(edges: DataFrame, sources: DataFrame, metrics: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """All non-dominated (ride, change) cost vectors from each source, with path counts.

    ``edges`` has (a, b, dr, dt) with dr + dt = 1 and optional metric columns, whose least and
    greatest path sums come along (null metric: the edge is uncovered). Labels grow one
    cost level at a time; labels of one level cannot dominate each other, so a new label only
    has to be tested against the accepted labels of its own node.
    Returns the labels and their parent links.
    """
    zero = F.lit(0).cast("bigint")
    level = sources.select("source", F.col("source").alias("node"), zero.alias("r"), zero.alias("c"), F.lit(1).cast("bigint").alias("paths"),
                           F.lit(1).cast("bigint").alias("covered"), F.array("source").alias("path"),
                           *[F.lit(0.0).alias(f"{m}_{s}") for m in metrics for s in ("lo", "hi")])
    level = cut_lineage(level)
    labels, parents = level, None
    ok = F.lit(True)
    for m in metrics:
        ok = ok & F.col(m).isNotNull()
    ok = ok & (F.col("covered") > 0)
    while True:
        x = level.withColumnRenamed("node", "a").join(edges, "a").withColumns({"nr": F.col("r") + F.col("dr"), "nc": F.col("c") + F.col("dt")})
        x = cut_lineage(x.select("source", "a", F.col("b").alias("node"), "r", "c", "nr", "nc", "paths", F.when(ok, F.col("covered")).otherwise(0).alias("covered"),
                                 F.concat("path", F.array("b")).alias("path"),
                                 *[F.when(ok, F.col(f"{m}_{s}") + F.col(m)).alias(f"{m}_{s}") for m in metrics for s in ("lo", "hi")]))
        g = x.groupBy("source", "node", F.col("nr").alias("r"), F.col("nc").alias("c")).agg(
            F.sum("paths").alias("paths"), F.sum("covered").alias("covered"), F.min("path").alias("path"),
            *[(F.min if s == "lo" else F.max)(f"{m}_{s}").alias(f"{m}_{s}") for m in metrics for s in ("lo", "hi")])
        old = labels.select(F.col("source").alias("s2"), F.col("node").alias("n2"), F.col("r").alias("r2"), F.col("c").alias("c2"))
        level = cut_lineage(g.join(old, (F.col("source") == F.col("s2")) & (F.col("node") == F.col("n2")) & (F.col("r2") <= F.col("r")) & (F.col("c2") <= F.col("c")), "left_anti"))
        if level.isEmpty():
            return labels, parents
        link = x.select("source", "node", F.col("nr").alias("r"), F.col("nc").alias("c"), F.col("a").alias("pnode"), F.col("r").alias("pr"), F.col("c").alias("pc"))
        link = link.join(level.select("source", "node", "r", "c"), ["source", "node", "r", "c"], "left_semi")
        parents = link if parents is None else parents.unionByName(link)
        labels = labels.unionByName(level)


def tied_paths(labels: DataFrame, parents: DataFrame, targets: DataFrame) -> DataFrame:
    """Every path of every frontier label of the target nodes, walked back over the parent links."""
    front = labels.join(targets.select("node"), "node", "left_semi").select(
        "source", F.col("node").alias("target"), F.col("r").alias("tr"), F.col("c").alias("tc"), "node", "r", "c", F.array("node").alias("path"))
    done = None
    while True:
        home = front.where("node = source and r = 0 and c = 0").select("source", "target", "tr", "tc", "path")
        done = home if done is None else done.unionByName(home)
        front = front.where("not (node = source and r = 0 and c = 0)")
        if front.isEmpty():
            return done
        j = front.join(parents, ["source", "node", "r", "c"])
        front = cut_lineage(j.select("source", "target", "tr", "tc", F.col("pnode").alias("node"), F.col("pr").alias("r"), F.col("pc").alias("c"),
                                     F.concat(F.array("pnode"), "path").alias("path")))


def path_metric(steps: DataFrame, path: Sequence[str], seq: str, node: str, line: str, chunk: Column, prior: DataFrame, metric: str) -> DataFrame:
    """Sum of an edge metric along each path; null when a ride edge has none, with the number missing."""
    x = skew.neighbour(steps, path, [seq], chunk, [node, line], "nx", following=True).where("nx is not null")
    same = F.col(line) == F.col(f"nx.{line}")
    rides = x.where(same & (F.col(node) != F.col(f"nx.{node}"))).select(*path, F.col(line).alias("line"), F.least(F.col(node), F.col(f"nx.{node}")).alias("low"), F.greatest(F.col(node), F.col(f"nx.{node}")).alias("high"))
    j = rides.join(prior, ["line", "low", "high"], "left")
    g = j.groupBy(*path).agg(F.count(F.lit(1)).alias("ride_edges"), F.count_if(F.col(metric).isNull()).alias("missing"), F.sum(metric).alias("__s"))
    changes = x.groupBy(*path).agg(F.count_if(~same).alias("changes"))
    out = changes.join(g, list(path), "left").fillna(0, ["ride_edges", "missing"])
    return out.withColumn(metric, F.when(F.col("missing") == 0, F.coalesce("__s", F.lit(0.0)))).drop("__s")


def legs(steps: DataFrame, path: Sequence[str], seq: str, node: str, line: str, chunk: Column) -> DataFrame:
    """Maximal runs on one line: first and last node, first position."""
    x = skew.islands(steps, path, [seq], chunk, [line], lambda prev, cur: prev[line] == cur[line], "leg_no")
    return x.groupBy(*path, "leg_no", line).agg(F.min_by(node, seq).alias("from_node"), F.max_by(node, seq).alias("to_node"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))


def leg_options(edges: DataFrame, leg: Sequence[str], edge: Sequence[str], option: str, runtime: str) -> DataFrame:
    """Service options that cover every edge of a leg, with their run times summed."""
    per = edges.groupBy(*leg, *edge, option).agg(F.min(runtime).alias("__r"))
    n = per.select(*leg, *edge).distinct().groupBy(*leg).agg(F.count(F.lit(1)).alias("__edges"))
    o = per.groupBy(*leg, option).agg(F.count(F.lit(1)).alias("__n"), F.sum("__r").alias(runtime))
    return o.join(n, list(leg)).where("__n = __edges").drop("__n", "__edges")


def terminals(edges: DataFrame) -> DataFrame:
    """Nodes with a single neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")).where("degree = 1").select("node")


def fragment_gaps(stops: DataFrame, line: str, seq: str, component: str) -> DataFrame:
    """Neighbouring fragments of a line that lie in different components, with their sequence gap.

    Fragments are ordered along the line and each meets only the next one.
    """
    f = stops.groupBy(line, component).agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"), F.count(F.lit(1)).alias("stops"))
    x = skew.neighbour(f, [line], ["lo", component], skew.span("lo", 1000), ["lo", component, "stops"], "nx", following=True)
    return x.where("nx is not null").select(line, F.col(component).alias("component_a"), F.col(f"nx.{component}").alias("component_b"),
                                            (F.col("nx.lo") - F.col("hi")).alias("gap"), "stops", F.col("nx.stops").alias("next_stops"))


def bridge_evidence(nodes: DataFrame, keys: dict[str, tuple[str, int]], component: str, line: str) -> DataFrame:
    """Component pairs that share an evidence key on different lines, with the best strength and the kinds seen.

    Nodes are reduced to distinct (key, component, line) first; within a key only different
    components meet, which is the result itself.
    """
    rows = None
    for kind, (col, strength) in keys.items():
        r = nodes.where(F.col(col).isNotNull()).select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("key"), F.lit(strength).alias("strength"), component, line).distinct()
        rows = r if rows is None else rows.unionByName(r)
    b = rows.select("kind", "key", F.col(component).alias("cb"), F.col(line).alias("lb"))
    j = rows.withColumnsRenamed({component: "ca", line: "la"}).join(b, ["kind", "key"]).where("ca < cb and la <> lb")
    return j.groupBy("ca", "cb").agg(F.max("strength").alias("strength"), F.count_distinct("kind").alias("kinds"), F.count_distinct("kind", "key").alias("keys"))


def segment_classes(want: DataFrame, variants: DataFrame, line: str, root: str, reach: int) -> DataFrame:
    """Class of each wanted segment (line, o, d) by the service variants (line, root, f, t) of its line.

    EXACT: a variant runs from o to d. VARIANT: one root stops at both, in different
    variants. INTERIOR: a variant passes both. NEAR: one stops within ``reach`` stations of
    an end. OPPOSITE: one joins both against the direction. Else NONE. Stations are
    numbered along the line; but for OPPOSITE only variants in the segment's direction
    count. Every class is found by an equality join or a running maximum, none by pairs.
    """
    sign = lambda a, b: F.signum(F.col(b) - F.col(a)).cast("int")
    w = want.select(line, "o", "d").distinct().withColumn("s", sign("o", "d"))
    v = variants.select(line, root, "f", "t").distinct().withColumn("s", sign("f", "t"))
    keys = [line, "o", "d"]
    stops = v.select(line, root, "s", F.explode(F.array("f", "t")).alias("stop")).distinct()
    exact = w.join(v.select(line, F.col("f").alias("o"), F.col("t").alias("d"), "s"), [*keys, "s"], "left_semi")
    against = w.join(v.select(line, F.col("t").alias("o"), F.col("f").alias("d"), (-F.col("s")).alias("s")), [*keys, "s"], "left_semi")
    at = lambda end: w.join(stops.withColumnRenamed("stop", end), [line, "s", end]).select(*keys, root)
    both = at("o").join(at("d"), [*keys, root], "left_semi")
    lo, hi = F.least("o", "d"), F.greatest("o", "d")
    marks = v.select(line, "s", F.least("f", "t").alias("at"), F.greatest("f", "t").alias("upto"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("o"), F.lit(None).cast("int").alias("d"))
    asks = w.select(line, "s", lo.alias("at"), F.lit(None).cast("int").alias("upto"), F.lit(1).alias("side"), "o", "d")
    run = skew.running(marks.unionByName(asks).withColumn("__id", F.monotonically_increasing_id()), [line, "s"], ["at", "side", "__id"], skew.span("at", 1000), {"reached": ("max", "upto")})
    inside = run.where((F.col("side") == 1) & (F.col("reached") >= hi))
    beside = w.select(*keys, "s", F.explode(F.flatten(F.array(*[F.sequence(F.col(e) - reach, F.col(e) + reach) for e in ("o", "d")]))).alias("stop")).join(stops, [line, "s", "stop"], "left_semi")
    out = w
    for name, found in (("exact", exact), ("variant", both), ("interior", inside), ("near", beside), ("opposite", against)):
        out = out.join(found.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
    cls = F.when(F.col("exact"), "EXACT").when(F.col("variant"), "VARIANT").when(F.col("interior"), "INTERIOR").when(F.col("near"), "NEAR").when(F.col("opposite"), "OPPOSITE").otherwise("NONE")
    return out.select(*keys, cls.alias("class"))
