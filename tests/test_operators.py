"""Edge cases of single operators on small literal tables, and brute-force checks."""

import hashlib
import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.functions import clocks, dist, text
from ledgerline.operators import assign as B
from ledgerline.operators import audit as V
from ledgerline.operators import contracts as C
from ledgerline.operators import graph as N
from ledgerline.operators import sequence as S
from ledgerline.operators import signal as G
from ledgerline.operators import spatial as SP
from ledgerline.operators import timetable as TT
from ledgerline.session import fresh_path
from ledgerline.sources import readers as RD
from ledgerline.sources import sinks as SK
from ledgerline.streaming import accumulate as AC
from ledgerline.streaming import pairing as PA


def state_machine(events, max_s):
    """Sequential pairing with an open entry: the reference behaviour of the barrier form."""
    counts = {}
    for e in events:
        counts[e[1]] = counts.get(e[1], 0) + 1
    opened, out = None, []
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        if counts[e[1]] > 1 or e[3] == "BARRIER":
            opened = None
        elif e[3] == "ENTRY":
            opened = e
        elif opened is not None:
            if e[1] - opened[1] <= max_s:
                out.append((e[0], opened[4], e[4], opened[1], e[1]))
            opened = None
    return out


def random_events(n, seed, users=6, span=90_000):
    r = random.Random(seed)
    kinds = ["ENTRY", "EXIT", "BARRIER"]
    return [(0 if r.random() < 0.4 else r.randrange(users), r.randrange(span // 60) * 60, i, r.choices(kinds, [4, 4, 1])[0], r.randrange(9)) for i in range(n)]


@pytest.mark.parametrize("width", [300, 5000, 10 ** 6])
def test_barrier_pairs_equal_state_machine(spark, width):
    ev = random_events(600, width)
    df = spark.createDataFrame(ev, "user_id int, s long, seq int, kind string, station int")
    got = S.barrier_pairs(df, "user_id", "s", "seq", "kind", ["station"], skew.span("s", width), max_s=9000).collect()
    want = [p for u in {e[0] for e in ev} for p in state_machine([e for e in ev if e[0] == u], 9000)]
    assert sorted((g.user_id, g.entry_station, g.exit_station, g.entry_s, g.exit_s) for g in got) == sorted(want)


def test_stream_pairing_over_batches_equals_batch(spark, tmp_path):
    ev = random_events(400, 77, span=40_000)
    top = max(e[1] for e in ev)
    # the last instant belongs to the result: two users leave at it, one of them also enters at it
    ev += [(901, top - 500, 9001, "ENTRY", 1), (901, top, 9002, "EXIT", 2), (902, top - 400, 9003, "ENTRY", 3), (902, top, 9004, "EXIT", 4), (902, top, 9005, "ENTRY", 4)]
    src = tmp_path / "in"
    schema = "user_id long, s long, seq long, kind string, station int"
    for n, (lo, hi) in enumerate([(0, 9000), (9000, 20_000), (20_000, top - 450), (top - 450, 10 ** 9)]):
        part = [e for e in ev if lo <= e[1] < hi]
        seen = set(src.glob("*.parquet"))
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        for f in set(src.glob("*.parquet")) - seen:
            os.utime(f, (10 ** 9 + n * 10, 10 ** 9 + n * 10))
    events = lambda s: AC.file_stream(s, str(src), schema, files_per_batch=1).withColumn("ts", F.timestamp_seconds("s"))
    store = spark.conf.get(PA.STATE_STORE[0], "")
    pairs = PA.pair_files(spark, events, str(tmp_path / "out"), str(tmp_path / "cp"), max_s=9000)
    got = sorted((r.user_id, r.entry_station, r.exit_station, r.entry_s, r.exit_s) for r in pairs.collect())
    want = sorted(p for u in {e[0] for e in ev} for p in state_machine([e for e in ev if e[0] == u], 9000))
    assert got == want and (901, 1, 2, top - 500, top) in got and not any(g[0] == 902 for g in got)
    assert spark.conf.get(PA.STATE_STORE[0], "") == store
    # a second run over a new file goes on from the state as if nothing had been flushed
    more = [(901, top + 10, 9006, "ENTRY", 5), (901, top + 20, 9007, "EXIT", 6)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(src))
    again = PA.pair_files(spark, events, str(tmp_path / "out"), str(tmp_path / "cp"), max_s=9000)
    got = sorted((r.user_id, r.entry_station, r.exit_station, r.entry_s, r.exit_s) for r in again.collect())
    assert got == sorted([*want, (901, 5, 6, top + 10, top + 20)])


def test_accumulation_is_idempotent(spark, tmp_path):
    src, store, cp = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")
    spark.createDataFrame([(1,), (1,), (2,)], "k int").coalesce(1).write.parquet(src)
    for _ in range(2):
        AC.run_to_end(AC.accumulate_counts(AC.file_stream(spark, src, "k int"), ["k"], store, cp))
    assert sorted(tuple(r) for r in AC.read_store(spark, store, ["k"]).collect()) == [(1, 2), (2, 1)]
    spark.createDataFrame([(2,)], "k int").coalesce(1).write.mode("append").parquet(src)
    AC.run_to_end(AC.accumulate_counts(AC.file_stream(spark, src, "k int"), ["k"], store, cp))
    assert sorted(tuple(r) for r in AC.read_store(spark, store, ["k"]).collect()) == [(1, 2), (2, 2)]


def test_exact_int_and_clock_edges(spark):
    df = spark.createDataFrame([("7",), ("7.0",), ("7.5",), ("9007199254740993",), ("nan",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(C.exact_int(F.col("s"))).collect()] == [7, 7, None, None, None, None, None]
    c = spark.createDataFrame([(60000,), (61000,), (224959,), (225000,), (230000,), (55000,), (66000,), (-1,)], "c int")
    assert [r[0] for r in c.select(clocks.clock_to_slot(F.col("c"))).collect()] == [0, 1, None, 101, None, None, None, None]
    g = spark.createDataFrame([("25:01:02",), ("bad",), ("1:2",), ("a:b:c",)], "s string")
    assert [r[0] for r in g.select(clocks.gtfs_seconds(F.col("s"))).collect()] == [90062, None, None, None]
    t = spark.createDataFrame([("3号线人民广场",), ("人民广场",), ("﻿11号线 徐家汇 ",)], "s string")
    got = [r[0] for r in t.select(text.line_station(F.col("s"))).collect()]
    assert (got[0].line, got[0].station) == ("03", "人民广场") and got[1] is None and got[2].station == "徐家汇"


def test_erf_error_bound(spark):
    import math
    x = np.linspace(-6, 6, 2001)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r[0] for r in df.select(dist.erf(F.col("x"))).collect()]
    assert max(abs(a - math.erf(v)) for a, v in zip(got, x)) < 1.5e-7
    exact = [r[0] for r in df.limit(50).select(dist.erf_exact(F.col("x"))).collect()]
    assert max(abs(a - math.erf(v)) for a, v in zip(exact, x)) < 1e-15


def test_gates_and_schema(spark):
    facts = spark.createDataFrame([(3, 3, 0)], "a int, b int, c int")
    row = C.gates(facts, {"same": F.col("a") == F.col("b"), "none": F.col("c") == 0})
    C.enforce(row)
    with pytest.raises(C.ContractError, match="none"):
        C.enforce(C.gates(facts, {"same": F.col("a") == F.col("b"), "none": F.col("c") == 1}))
    with pytest.raises(C.ContractError):
        C.require_columns(facts, ["zz"])


def test_unique_side_is_enforced(spark):
    from ledgerline.operators.joins import validated_join
    left = spark.createDataFrame([(1, 2), (1, 3)], "k int, a int")
    good = spark.createDataFrame([(1, 9)], "k int, b int")
    assert validated_join(left, good, ["k"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        validated_join(left, good.union(good), ["k"]).collect()


def test_publish_refuses_to_overwrite(spark):
    path = fresh_path(spark, "pub")
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    SK.publish(df, path, ["x"])
    assert RD.path_exists(spark, f"{path}/{SK.MARKER}") and spark.read.parquet(path).count() == 5
    with pytest.raises(C.ContractError):
        SK.publish(df, path, ["x"])


def test_digests_and_manifest(spark, tmp_path):
    for name, body in (("a.bin", b"alpha"), ("b.bin", b"beta")):
        (tmp_path / name).write_bytes(body)
    d = RD.file_digests(spark, str(tmp_path), "*.bin")
    assert {(r.file, r.bytes, r.sha256) for r in d.collect()} == {(n, len(b), hashlib.sha256(b).hexdigest()) for n, b in (("a.bin", b"alpha"), ("b.bin", b"beta"))}
    manifest = spark.createDataFrame([("a.bin", 5, hashlib.sha256(b"alpha").hexdigest()), ("b.bin", 4, "0" * 64), ("c.bin", 1, "0" * 64)], "file string, bytes long, sha256 string")
    assert {(r.file, r.problem) for r in RD.verify_manifest(d, manifest).collect()} == {("b.bin", "DIGEST"), ("c.bin", "MISSING")}


def test_moving_average_edges(spark):
    x = [3, 0, 1, 4, 0, 2, 5]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "k int, bin int, x int")
    got = G.moving_averages(df, ["k"], "bin", "x", {"m3": 3, "m4": 4}).orderBy("bin").collect()
    for w, name in ((3, "m3"), (4, "m4")):
        assert [g[name] for g in got] == pytest.approx(np.convolve(x, np.ones(w) / w, mode="same"))


def test_two_means_split(spark):
    pos = [0.0, 5.0, 8.0, 90.0, 95.0, 99.0, 101.0]
    df = spark.createDataFrame([(0, p, 1.0, str(i)) for i, p in enumerate(pos)], "k int, pos double, weight double, member string")
    side = {r.pos: r.side for r in G.two_means_split(df, ["k"]).collect()}
    assert {p for p in pos if side[p] == side[0.0]} == {0.0, 5.0, 8.0}
    tight = spark.createDataFrame([(0, p / 100, 1.0, str(i)) for i, p in enumerate(pos)], "k int, pos double, weight double, member string")
    assert {r.side for r in G.two_means_split(tight, ["k"]).collect()} == {-1}


def test_chain_smoothing_equals_dense_solve(spark):
    r = random.Random(9)
    data = [(root, seq, (100.0 * seq + r.gauss(0, 9)) if r.random() < 0.6 or seq == 0 else None, 5.0 + r.random() * 20, 95.0 + r.random() * 10, 3.0 + r.random() * 9) for root in range(5) for seq in range(7)]
    got = {(g.root, g.seq): g for g in TT.smooth_roots(spark.createDataFrame(data, "root long, seq int, anchor double, anchor_sd double, lag double, lag_sd double")).collect()}
    for root in range(5):
        d = [x for x in data if x[0] == root]
        q, b = np.zeros((7, 7)), np.zeros(7)
        for j, x in enumerate(d):
            if x[2] is not None:
                q[j, j] += 1 / x[3] ** 2
                b[j] += x[2] / x[3] ** 2
            if j:
                w = 1 / x[5] ** 2
                q[j, j] += w; q[j - 1, j - 1] += w; q[j, j - 1] -= w; q[j - 1, j] -= w
                b[j] += w * x[4]; b[j - 1] -= w * x[4]
        mean, sd = np.linalg.solve(q, b), np.sqrt(np.diag(np.linalg.inv(q)))
        assert [got[root, j].mean for j in range(7)] == pytest.approx(mean) and [got[root, j].sd for j in range(7)] == pytest.approx(sd)


def test_paths_against_brute_force(spark):
    r = random.Random(4)
    und = {(a, b): float(r.randrange(1, 6)) for a, b in itertools.combinations(range(7), 2) if r.random() < 0.5}
    adj = {**und, **{(b, a): w for (a, b), w in und.items()}}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in adj.items()], "a long, b long, cost double").cache()
    every = {}
    def walk(path, cost):
        every.setdefault((path[0], path[-1]), []).append((cost, path))
        for b in range(7):
            if b not in path and (path[-1], b) in adj:
                walk(path + [b], cost + adj[path[-1], b])
    for s in range(7):
        walk([s], 0.0)
    best = N.shortest_paths(e, spark.range(7).select(F.col("id").alias("source")))
    got = {(x.source, x.node): (x.cost, list(x.path)) for x in best.collect()}
    assert got == {k: min(v) for k, v in every.items()}
    pairs = best.where("source < node").select("source", F.col("node").alias("target"))
    ksp = N.simple_paths(e, pairs, best.select("source", "node", "cost"), 3, 1.6, 8.0)
    rows = {}
    for x in ksp.collect():
        rows.setdefault((x.source, x.target), []).append((x.route_rank, x.cost, list(x.path), x.truncated))
    for k, v in rows.items():
        base = min(v0[0] for v0 in every[k])
        ok = sorted(p for p in every[k] if p[0] <= max(base * 1.6, base + 8.0))
        assert [(c, p) for _, c, p, _ in sorted(v)] == ok[:3] and all(t == (len(ok) > 3) for *_, t in v)
    alt = N.route_alternatives(best.withColumn("policy", F.lit("p")).unionByName(best.withColumn("policy", F.lit("q"))), "policy").collect()
    assert all(list(x.policies) == ["p", "q"] and x.route_rank == 1 for x in alt)


def test_cover_and_bound(spark):
    from ledgerline.operators import audit as V
    r = random.Random(8)
    edges = sorted({(a, b) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.25})
    e = spark.createDataFrame(edges, "a long, b long")
    cover = {x.node for x in V.conflict_cover(e, spark.range(12).select(F.col("id").alias("node"), F.lit(1.0).alias("cost"))).collect()}
    assert all(a in cover or b in cover for a, b in edges)
    used, want = set(), set()
    for a, b in edges:
        if a not in used and b not in used:
            used |= {a, b}; want.add((a, b))
    got = {(x.a, x.b) for x in V.matching_bound(e).collect()}
    assert got == want and len(got) <= len(cover)


def test_cover_reads_costs_once_and_edges_are_those_of_the_conflicts(spark, monkeypatch):
    from ledgerline.operators import audit as V
    e = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    cost = spark.range(41).select(F.col("id").alias("node"), F.rand(3).alias("cost"))
    reads = []
    monkeypatch.setattr(type(cost), "join", lambda self, other, *a, _join=type(cost).join, **k: (reads.append(1) if "cost" in (*self.columns, *other.columns) else None, _join(self, other, *a, **k))[1])
    cover = {x.node for x in V.conflict_cover(e, cost).collect()}
    assert len(reads) == 1 and all(k in cover or k + 1 in cover for k in range(40))
    ev = spark.createDataFrame([(k, 0, k % 2, "Up", 1, 100 * k + k % 3 * 40) for k in range(60)], "service long, resource int, path int, direction string, station int, at long")
    b = spark.createDataFrame([(1, 0, None, None, 0, 3600, 130)], "band_id long, resource int, path int, direction string, band_start long, band_end long, floor long")
    want = {(x.a, x.b): x.worst_gap for x in V.headway_conflicts(ev, b, 250.0).collect()}
    at = [100 * k + k % 3 * 40 for k in range(60)]
    order = sorted(range(60), key=lambda k: (at[k], k))
    brute = {(min(p, q), max(p, q)): at[q] - at[p] for p, q in zip(order, order[1:]) if at[q] - at[p] < (130 if (at[p] + at[q]) / 2 < 3600 else 90)}
    assert want == brute and {(x.a, x.b) for x in V.conflict_edges(ev, b, 250.0).collect()} == set(brute)


def test_joined_components_are_those_of_all_edges(spark):
    from ledgerline.operators import graph as N
    nodes = spark.range(5, 12).select(F.col("id").alias("node"))
    near = spark.createDataFrame([(5, 6), (8, 9)], "a long, b long")
    far = spark.createDataFrame([(9, 6), (7, 3), (10, 3), (11, 11)], "a long, b long")  # 3 is no node
    got = {x.node: (x.component, x.joined) for x in N.joined_components(N.connected_components(nodes, near), far).collect()}
    assert got == {5: (5, 5), 6: (5, 5), 7: (7, 3), 8: (8, 5), 9: (8, 5), 10: (10, 3), 11: (11, 11)}
    assert {k: v[1] for k, v in got.items()} == {x.node: x.component for x in N.connected_components(nodes, near.unionByName(far)).collect()}


def test_nothing_keeps_the_card_key(spark):
    ev = spark.createDataFrame([(5, 10 ** 6, 1, 1, 3), (5, 2 * 10 ** 6, 2, 0, 4)], "user_id int, us long, seq int, status int, station int")
    p = S.pair_entry_exit(ev, "user_id", ["us", "seq"], "us", "status", ["station"], skew.span("us", 10 ** 6))
    assert "user_id" not in p.columns and p.count() == 1


def test_rejects_are_written_by_reason_and_counted(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 7, None if i % 5 == 0 else i) for i in range(200)], "id long, kind int, value long").repartition(4)
    reasons = [("NO_VALUE", F.col("value").isNull()), ("KIND", F.col("kind") > 4), ("NEVER", F.col("id") < 0)]
    back, counts = SK.route_rejects(df, reasons, str(tmp_path / "routed"))
    want = {}
    for i in range(200):
        want.setdefault("NO_VALUE" if i % 5 == 0 else "KIND" if i % 7 > 4 else "ACCEPTED", set()).add(i)
    got = {}
    for r in back.select("reason", "id").collect():
        got.setdefault(r.reason, set()).add(r.id)
    assert got == want and counts == {"ACCEPTED": len(want["ACCEPTED"]), "NO_VALUE": len(want["NO_VALUE"]), "KIND": len(want["KIND"]), "NEVER": 0}
    back, counts = SK.route_rejects(df.where("id < 0"), reasons, str(tmp_path / "none"))
    assert back.count() == 0 and not any(counts.values())


def test_parts_are_checked_against_their_manifest(spark, tmp_path):
    df = spark.createDataFrame([(i // 10, i, f"é{i}") for i in range(40)], "part long, id long, word string").repartition(5)
    path = str(tmp_path / "parts")
    SK.write_text_parts(df, "part", ["id"], path)
    manifest = SK.text_manifest(df, "part", ["id"], ["id", "word"])
    body = "id,word\n" + "".join(f"{i},é{i}\n" for i in range(10))
    first = manifest.where("part = 0").first()
    assert (first.rows, first.bytes, first.sha256) == (10, len(body.encode()), hashlib.sha256(body.encode()).hexdigest())
    status = lambda: {r.part: r.status for r in SK.verify_parts(spark, path, manifest, "part").collect()}
    assert status() == {k: "OK" for k in range(4)}
    file = {int(f.parent.name.split("=")[1]): f for f in (tmp_path / "parts").glob("part=*/part-*.csv")}
    for f in (tmp_path / "parts").glob("part=*/.*.crc"):  # the local file system's own checksums
        f.unlink()
    file[1].write_bytes(file[1].read_bytes().replace(b"15", b"51"))  # same length
    file[2].unlink()
    (tmp_path / "parts" / "part=9").mkdir()
    (tmp_path / "parts" / "part=9" / "part-0.csv").write_text("id,word\n")
    assert status() == {0: "OK", 1: "CHANGED", 2: "MISSING", 3: "OK", 9: "EXTRA"}


def test_headway_authority_with_open_fields(spark):
    rng = random.Random(12)
    bands = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, 2, None]), rng.choice(["Down", "Up", None]), 3600 * (s := rng.randrange(0, 20)) + 30, 3600 * (s + rng.randrange(1, 4)), rng.choice([60, 300, 600])) for i in range(14)]
    events = [(i, r := rng.choice([0, 1, 2]), rng.choice([0, 1, 2]), rng.choice(["Down", "Up"]), 10 * r + rng.randrange(2), rng.randrange(0, 2 * 86400)) for i in range(300)]
    events += [(0, 0, 0, "Down", 5, 50_000), (1, 0, 0, "Down", 5, 50_010), (0, 0, 0, "Down", 6, 50_000), (1, 0, 0, "Down", 6, 50_040)]

    def floor(resource, path, direction, at):
        live = [(f, -b) for b, r, p, d, lo, hi, f in bands if r in (None, resource) and p in (None, path) and d in (None, direction) and lo <= at < hi and f > 90]
        return (max(live)[0], -max(live)[1]) if live else (90, None)

    b = spark.createDataFrame(bands, "band_id long, resource int, path int, direction string, band_start long, band_end long, floor long")
    e = spark.createDataFrame(events, "service long, resource int, path int, direction string, station int, at long")
    got = V.headway_floors(e.withColumn("clock", F.col("at") % 86400), b, "clock").collect()
    assert sorted((r.service, r.station, r.at, r.floor, r.band_id or -1) for r in got) == sorted(
        (s, st, at, floor(r, p, d, at % 86400)[0], floor(r, p, d, at % 86400)[1] or (floor(r, p, d, at % 86400)[1] == 0 and 0) or -1) for s, r, p, d, st, at in events)
    want, line = {}, {}
    for s, r, p, d, st, at in events:
        line.setdefault((r, d, st), []).append((at, s, p))
    for (r, d, st), seq in line.items():
        seq.sort()
        for (t0, a, p0), (t1, c, p1) in zip(seq, seq[1:], strict=False):
            mid = ((t0 + t1) / 2) % 86400
            sides = [floor(r, p, d, mid) for p in (p0, p1)]
            need = max(f for f, _ in sides)
            if t1 - t0 < need:
                x = want.setdefault((min(a, c), max(a, c)), [0, set(), set(), []])
                x[0] += 1
                x[1].add(r)
                x[2] |= {i for _, i in sides if i is not None}
                x[3].append((t1 - t0 - need, r, d, st))
    rows = V.headway_conflicts(e, b, 20_000.0).collect()
    assert {(r.a, r.b): (r.observations, r.resources, r.bands, (-r.shortfall, r.worst_resource, r.worst_direction, r.worst_station)) for r in rows} == {
        k: (n, sorted(res), sorted(ids), min(obs)) for k, (n, res, ids, obs) in want.items()}
    assert want[0, 1][0] >= 2


def best_links(arrivals, departures, least, most):
    """Most links and their least total gap, over all matchings."""
    states = {(frozenset(), 0): 0}
    for a in arrivals:
        for (used, links), gap in list(states.items()):
            for j, d in enumerate(departures):
                if j not in used and least <= d - a <= most:
                    key = (used | {j}, links + 1)
                    states[key] = min(states.get(key, 10**9), gap + d - a)
    top = max(links for _, links in states)
    return top, min(g for (_, links), g in states.items() if links == top)


def test_turnback_links_reach_the_objective(spark):
    rng = random.Random(5)
    arrivals, departures, want = [], [], {}
    for key in range(40):
        a = [rng.randrange(0, 60) for _ in range(rng.randrange(0, 6))]
        d = [rng.randrange(0, 60) for _ in range(rng.randrange(0, 6))]
        arrivals += [(key, 100 * key + i, t) for i, t in enumerate(a)]
        departures += [(key, 100 * key + 50 + i, t) for i, t in enumerate(d)]
        want[key] = best_links(a, d, 2, 12)
    arrivals += [(99, 1, 0), (99, 2, 100)]
    departures += [(99, 3, 300)]
    ddl = "key int, id long, at long"
    out = V.turnback_links(spark.createDataFrame(arrivals, ddl), spark.createDataFrame(departures, ddl), ["key"], 2, 12, 20.0, block=2).collect()
    for key, (links, gap) in want.items():
        own = [r for r in out if r.key == key]
        assert (len(own), sum(r.gap for r in own)) == (links, gap)
        assert len({r.arrival for r in own}) == len({r.departure for r in own}) == links and all(2 <= r.gap <= 12 for r in own)
    late = V.turnback_links(spark.createDataFrame(arrivals[-2:], ddl), spark.createDataFrame(departures[-1:], ddl), ["key"], 120, 1000, 5000.0).first()
    assert (late.arrival, late.gap) == (2, 200)  # the later arrival waits less


def greedy_links(arrivals, departures, least, most):
    """Departures of an earliest-first pass and arrivals of a latest-first pass, by rank."""
    first, i = [], 0
    for d in sorted(departures):
        while i < len(arrivals) and sorted(arrivals)[i][0] < d[0] - most:
            i += 1
        if i < len(arrivals) and sorted(arrivals)[i][0] + least <= d[0]:
            first.append(d)
            i += 1
    last, rest = [], sorted(departures)
    for a in sorted(arrivals, reverse=True):
        while rest and rest[-1][0] > a[0] + most:
            rest.pop()
        if rest and rest[-1][0] >= a[0] + least:
            last.append(a)
            rest.pop()
    return sorted((a[1], d[1], d[0] - a[0]) for a, d in zip(sorted(last), first, strict=True))


def test_turnback_links_of_a_busy_key_in_blocks(spark):
    rng = random.Random(11)
    # one key has nine tenths of the rows and no quiet time; a null key is a key
    rows = [(1 if rng.random() < 0.9 else None, i, rng.randrange(0, 900), rng.random() < 0.5) for i in range(600)]
    part = lambda leaves: spark.createDataFrame([r[:3] for r in rows if r[3] is leaves], "key int, id long, at long")
    out = V.turnback_links(part(False), part(True), ["key"], 5, 40, 50.0, block=16).collect()
    for key in (1, None):
        own = [(t, i) for k, i, t, leaves in rows if k == key and not leaves], [(t, i) for k, i, t, leaves in rows if k == key and leaves]
        assert sorted((r.arrival, r.departure, r.gap) for r in out if r.key == key) == greedy_links(*own, 5, 40)


def test_circulations_are_ordered_chains(spark):
    n = 1000
    services = [(i, 10 * i) for i in range(n)] + [(5000, 5), (6001, 7), (6000, 7)]
    links = [(i, i + 1) for i in range(n - 1)] + [(6000, 6001)]
    random.Random(1).shuffle(links)
    sv = lambda rows: spark.createDataFrame(rows, "id long, at long")
    ln = lambda rows: spark.createDataFrame(rows, "arrival long, departure long")
    rounds = []
    cut = V.cut_lineage
    V.cut_lineage = lambda df: rounds.append(1) or cut(df)
    try:
        out = V.circulations(sv(services), ln(links), 1000.0).collect()
    finally:
        V.cut_lineage = cut
    assert (len(rounds) - 3) / 2 < 12  # two tables a round
    got = {r.id: (r.circulation, r.position, r.length) for r in out}
    assert len(out) == len(services) and all(got[i] == (0, i, n) for i in range(n))
    assert got[5000] == (1, 0, 1) and got[6000] == (2, 0, 2) and got[6001] == (2, 1, 2)
    with pytest.raises(ValueError, match="predecessors"):
        V.circulations(sv(services), ln([(1, 3), (2, 3)]), 1000.0)
    with pytest.raises(ValueError, match="successors"):
        V.circulations(sv(services), ln([(1, 3), (1, 4)]), 1000.0)
    with pytest.raises(ValueError, match="cycle"):
        V.circulations(sv(services), ln([(1, 2), (2, 3), (3, 1)]), 1000.0)
    # an alternating chain and a service left alone
    out = V.circulations(spark.createDataFrame([(1, 0), (2, 140), (3, 280), (4, 430), (9, 900)], "id long, at long"), ln([(1, 2), (2, 3), (3, 4)]), 1000.0).collect()
    assert sorted((r.circulation, r.position, r.id) for r in out) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (1, 0, 9)]


def test_routes_of_any_length_keep_their_cohorts(spark):
    legs = [(0, 9, r, n, k + 1, a, b) for r, path in ((1, [0, 9]), (2, [0, 1, 2, 9]), (3, [0, 1, 2, 3, 4, 9])) for n in [len(path) - 1] for k, (a, b) in enumerate(zip(path, path[1:], strict=False))]
    legs.append((0, 9, 4, 2, 1, 0, 1))  # its second leg is missing
    routes = spark.createDataFrame(legs, "from_station int, to_station int, route_rank int, legs int, leg_no int, leg_from int, leg_to int")
    edges = sorted({(x[5], x[6]) for x in legs} - {(0, 9)})
    rides = spark.createDataFrame([(100 * i + k, a, b, t, t + 50) for i, (a, b) in enumerate(edges) for k, t in enumerate(range(100, 2000, 100))],
                                  "ride_id long, from_station int, to_station int, dep long, arr long")
    cohorts = spark.createDataFrame([(1, 0, 9, 50, 1900), (2, 0, 9, 50, 400)], "cohort long, from_station int, to_station int, entry long, exit long")
    out = {(r.cohort, r.route_rank): r.reason for r in B.earliest_chains(cohorts, routes, rides, 1000.0).collect()}
    assert len(out) == 8
    assert out[1, 1] == "FIRST_LEG_NO_SERVICE" and out[1, 4] == "ROUTE_HAS_NO_RIDE_LEGS"
    assert [out[1, k] for k in (2, 3)] == ["FEASIBLE_COMPLETE_CHAIN"] * 2 and out[2, 3] == "FINAL_EGRESS_HORIZON"


def test_chains_go_on_over_empty_chunks_of_time_and_need_a_ready_time(spark):
    routes = spark.createDataFrame([(0, 9, 1, 3, k, a, b, 3.0) for k, (a, b) in enumerate(((0, 1), (1, 2), (2, 9)), 1)],
                                   "from_station int, to_station int, route_rank int, legs int, leg_no int, leg_from int, leg_to int, cost double")
    rides = spark.createDataFrame([(1, 0, 1, 500, 560), (2, 0, 1, 505, 550), (3, 1, 2, 90_000, 91_000), (4, 1, 2, 540, 600), (5, 2, 9, 90_900, 92_000), (6, 2, 9, 250_000, 250_010)],
                                  "ride_id long, from_station int, to_station int, dep long, arr long")
    cohorts = spark.createDataFrame([(1, 0, 9, -5000, 300_000), (2, 0, 9, 490, 200_000), (3, 0, 9, 491, 300_000), (4, 0, 9, None, 300_000)], "cohort long, from_station int, to_station int, entry long, exit long")
    for width in (10, 1000, 1_000_000):
        x = {r.cohort: r for r in B.earliest_chains(cohorts, routes, rides, width).collect()}
        assert [x[k].reason for k in (1, 2, 3, 4)] == ["FEASIBLE_COMPLETE_CHAIN", "FINAL_EGRESS_HORIZON", "FIRST_LEG_NO_SERVICE", "FIRST_LEG_NO_SERVICE"]
        assert [s.ride for s in x[1].chain] == [2, 3, 6] and x[2].excess == 250_010 - 199_985 and [s.leg_to for s in x[2].chain] == [1, 2, 9] and x[4].chain == []


def test_csv_values_that_do_not_fit_fail(spark, tmp_path):
    for name, text_, bad in (("good", "a,b\n1,2.5\n,\n 7 ,3\n", False), ("fraction", "a,b\n2.5,1\n", True), ("word", "a,b\nx,1\n", True), ("number", "a,b\n1,x\n", True)):
        path = tmp_path / f"{name}.csv"
        path.write_text(text_)
        df = RD.read_csv(spark, str(path), "a bigint, b double")
        if bad:
            with pytest.raises(Exception, match="not a value of type"):
                df.collect()
        else:
            assert [tuple(r) for r in df.collect()] == [(1, 2.5), (None, None), (7, 3.0)]
    with pytest.raises(C.ContractError):
        RD.read_csv(spark, str(tmp_path / "good.csv"), "a bigint, c string")
    assert RD.read_csv(spark, str(tmp_path / "good.csv"), "a bigint, c string", optional=["c"]).where("c is null").count() == 3


def test_hazard_of_many_departures_stays_finite(spark):
    pairs = spark.range(1000).select(F.lit(1).alias("cohort"), (F.col("id") + 1).cast("double").alias("gap"), F.col("id").alias("order"))
    got = [r.boarding for r in TT.hazard_scores(pairs, "cohort", "gap", "order", np.log(200.0), 0.8, 0.2).orderBy("gap").collect()]
    cdf = [r[0] for r in pairs.orderBy("gap").select(dist.lognormal_cdf(F.col("gap"), F.lit(float(np.log(200.0))), F.lit(0.8))).collect()]
    s, before = 0.0, 0.0
    for value, c in zip(got, cdf, strict=True):
        s = 0.2 * s + max(0.0, c - before)
        before = c
        assert value == pytest.approx(0.8 * s, rel=1e-9, abs=1e-15)


def brute_edge_times(trips):
    """Median run time per edge of each line and of all lines."""
    each = {}
    for line, obs in trips.values():
        for (p, a), (q, b) in zip(obs, obs[1:], strict=False):
            if 30 <= abs(b - a) / (q - p) <= 300:
                each.setdefault(line, []).append(abs(b - a) / (q - p))
    every = sorted(x for v in each.values() for x in v)
    return lambda line: float(np.median(each[line])) if line in each else float(np.median(every)) if every else 121.0


def random_trips(seed, n=30):
    rng, trips = random.Random(seed), {}
    for k in range(n):
        obs = sorted(rng.sample(range(-2, 12), rng.randrange(1, 6)))
        back = rng.random() < 0.4
        trips[k] = (k % 4, [(p, 1000.0 + (-1 if back else 1) * p * rng.randrange(60, 90) + rng.randrange(15)) for p in obs])
    return trips


def trip_frame(spark, trips):
    return spark.createDataFrame([(k, line, p, t) for k, (line, obs) in trips.items() for p, t in obs], "trip long, line long, pos long, t double")


def test_trips_are_completed_from_learnt_run_times(spark):
    trips = random_trips(3)
    trips[99] = (77, [(0, 5.0), (1, 6.0)])  # a line without a plausible run time
    per = brute_edge_times(trips)
    want = {}
    for k, (line, obs) in trips.items():
        ps, seen = [p for p, _ in obs], dict(obs)
        if len(obs) < 2:
            want |= {(k, p): (t, 0, True) for p, t in obs}
            continue
        sign, ref = (1 if obs[-1][1] >= obs[0][1] else -1), float(np.median(ps))
        at = float(np.median([t - sign * (p - ref) * per(line) for p, t in obs]))
        for p in range(min(0, *ps), max(10, *ps) + 1):
            want[k, p] = (seen[p], 0, True) if p in seen else (at + sign * (p - ref) * per(line), min(600, 30 + 25 * min(abs(p - q) for q in ps)), False)
    got = {(r.trip, r.pos): (r.filled, r.uncertainty, r.original) for r in S.complete_trips(trip_frame(spark, trips), "trip", "line", "pos", "t", 0, 10).collect()}
    assert got.keys() == want.keys()
    for key, (filled, unc, original) in want.items():
        assert got[key][0] == pytest.approx(filled, abs=1e-6) and got[key][1:] == (unc, original)


def test_completion_variants_keep_observed_events(spark):
    trips = random_trips(4)
    paths = {(line, v): order for line in range(4) for v, order in enumerate([list(range(-2, 13)), list(range(12, -3, -1)), [p for p in range(-2, 13) if p % 5 != 1]])}
    length = lambda a, b: 0.5 + (a + b) % 3
    cum = {key: [0.0 + sum(length(a, b) for a, b in zip(path[:i + 1], path[1:i + 1], strict=False)) for i in range(len(path))] for key, path in paths.items()}
    rows = [(line, v, i, n, cum[line, v][i]) for (line, v), path in paths.items() for i, n in enumerate(path)]
    per, want = brute_edge_times({k: x for k, x in trips.items() if len(x[1]) > 1}), {}
    for k, (line, obs) in trips.items():
        for v in range(3):
            path, c = paths[line, v], cum[line, v]
            ordered = sorted((t, p) for p, t in obs)
            if len(obs) < 2 or not all(p in path for p, _ in obs):
                continue
            on = [(path.index(p), t) for t, p in ordered]
            if not all(a[0] < b[0] and a[1] < b[1] for a, b in zip(on, on[1:], strict=False)):
                continue
            for i, n in enumerate(path):
                own, left, right = [t for j, t in on if j == i], [x for x in on if x[0] < i], [x for x in on if x[0] > i]
                if own:
                    want[k, v, n] = own[0]
                elif left and right:
                    (a, s), (b, e) = left[-1], right[0]
                    want[k, v, n] = s + (c[i] - c[a]) / (c[b] - c[a]) * (e - s)
                else:
                    want[k, v, n] = left[-1][1] + (c[i] - c[left[-1][0]]) * per(line) if left else right[0][1] - (c[right[0][0]] - c[i]) * per(line)
    variants = spark.createDataFrame(rows, "line long, variant int, i int, node long, cum double")
    out = S.complete_variants(trip_frame(spark, trips), variants, "trip", "line", "pos", "t", 15.0).collect()
    got = {(r.trip, r.variant, r.pos): r.filled for r in out}
    assert got.keys() == want.keys() and len({k[1] for k in want}) == 3
    assert all(got[k] == pytest.approx(t, abs=1e-6) for k, t in want.items())
    assert all(r.uncertainty == 15.0 for r in out if r.role == "ORIGINAL")


def test_offset_repair_interpolates_before_the_floor(spark):
    rng, rows, want = random.Random(6), [], {}
    for root in range(25):
        n = rng.randrange(1, 9)
        base, old = sorted(rng.uniform(0, 40 * n) for _ in range(n)), [rng.uniform(-60, 60) for _ in range(n)]
        direct = [rng.uniform(-400, 400) if rng.random() < 0.4 else None for _ in range(n)]
        w = [rng.uniform(1, 900) for _ in range(n)]
        rows += [(root, i, base[i], old[i], direct[i], w[i]) for i in range(n)]
        at = [i for i in range(n) if direct[i] is not None]
        if not at:
            want |= {(root, i): old[i] for i in range(n)}
            continue
        alpha = max(w[i] for i in at) / (max(w[i] for i in at) + 300.0)
        v = np.clip(alpha * np.interp(range(n), at, [direct[i] for i in at]) + (1 - alpha) * np.array(old), -180, 180)
        t = np.array(base) + v
        for i in range(1, n):
            t[i] = max(t[i], t[i - 1] + 1.0)
        want |= {(root, i): x for i, x in enumerate(np.clip(t - np.array(base), -180, 180))}
    df = spark.createDataFrame(rows, "root long, seq long, base double, old double, direct double, w double")
    got = {(r.root, r.seq): r.offset for r in S.repair_offsets(df, "root", "seq", "base", "old", "direct", "w").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(x, abs=1e-6) for k, x in want.items())


def test_upstream_completion_over_thirty_edges(spark):
    rng = random.Random(8)
    steps = [(29 - k, 30 - k, 100.0) for k in range(30)]
    pulses = [(s, float(rng.randrange(0, 8000)), rng.random()) for s in range(30) for _ in range(6)]
    anchors = [("a", 5000.0), ("b", 7777.0), ("c", 900.0)]
    out = G.complete_upstream(spark.createDataFrame(anchors, "root string, s double"), spark.createDataFrame(pulses, "station int, s double, score double"),
                              steps, "station", "s", "score", 60.0, 30.0, 500.0)
    want = set()
    for root, t in anchors:
        want.add((root, 0, 30, t, True))
        for n, (up, _, lag) in enumerate(steps, start=1):
            near = [(abs(p - (t - lag)), -w, p) for s, p, w in pulses if s == up and p <= t - 30 and abs(p - (t - lag)) <= 60 and t - lag >= 0]
            t = min(near)[2] if near else t - lag
            want.add((root, n, up, t, bool(near)))
    assert {(r.root, r.step, r.station, r.t, r.observed) for r in out.collect()} == want


def test_transfer_rules(spark):
    day = 19723 * 86400
    seg = lambda user, k, start, station, line, end_station, end_line: (user, station, line, day + start, 2 * k, end_station, end_line, day + start + 600, 2 * k + 1)
    rows = [seg(1, 0, 0, 1, 0, 7, 2), seg(1, 1, 1800, 7, 3, 9, 3), seg(1, 2, 3000, 9, 4, 5, 4),  # lines 2 and 3 meet at 7; nothing joins at 9
            seg(2, 0, 0, 1, 0, 7, 3), seg(2, 1, 1800, 7, 2, 9, 2),  # the pair in the other order
            seg(3, 0, 0, 1, 0, 7, 2), seg(3, 1, 2500, 7, 3, 9, 3),  # too late
            seg(4, 0, 0, 1, 0, 7, 2), seg(4, 1, 1800, 8, 3, 9, 3),  # another station
            seg(5, 0, 86400, 1, 0, 7, 2), seg(5, 1, 88200, 7, 3, 9, 3)]  # after the last day
    ddl = "user_id long, entry_station int, entry_line int, entry_s long, entry_pos long, exit_station int, exit_line int, exit_s long, exit_pos long"
    rule = S.transfer_rule([S.TransferRule(7, [(2, 3)], 19723, 19723)])
    out = S.stitch(spark.createDataFrame(rows, ddl), "user_id", skew.span("entry_s", 86400), rule, ["station", "line"]).collect()
    assert sorted((r.entry_station, r.exit_station, r.transfers) for r in out) == sorted(
        [(1, 9, 1), (9, 5, 0), (1, 9, 1), (1, 7, 0), (7, 9, 0), (1, 7, 0), (8, 9, 0), (1, 7, 0), (7, 9, 0)])


def test_scored_chains_write_beams_not_pairs(spark, monkeypatch):
    """40 cohorts meet 400 rides a leg: best chains as by brute force, and no table of pairs is written."""
    rng = random.Random(5)
    cohorts = [(i, 1, 3, rng.randrange(0, 4000), 40_000 + rng.randrange(0, 9000), 1) for i in range(40)]
    rides = [(j, a, b, d, d + 600 + j % 50, 10.0 + j % 20) for j, (a, b, d) in enumerate((rng.choice([(1, 3), (1, 2), (2, 3)]) + (rng.randrange(0, 60_000),)) for _ in range(400))]
    routes = [(1, 3, 1, 1, 1, 1, 3, 0.0), (1, 3, 2, 2, 1, 1, 2, 90.0), (1, 3, 2, 2, 2, 2, 3, 90.0)]
    kernels, written = {k: (14400.0, 1.2) for k in ("access", "transfer", "egress")}, []

    def counted(df):
        out = df.localCheckpoint()
        written.append(out.count())
        return out
    monkeypatch.setattr(B, "cut_lineage", counted)
    got = B.scored_chains(spark.createDataFrame(cohorts, "cohort long, from_station int, to_station int, entry long, exit long, mass long"),
                          spark.createDataFrame(routes, "from_station int, to_station int, route_rank int, legs int, leg_no int, leg_from int, leg_to int, cost double"),
                          spark.createDataFrame(rides, "ride_id long, from_station int, to_station int, dep long, arr long, sd double"), kernels, 8, 86400).collect()
    assert max(written) <= len(rides) + 16 * len(cohorts)
    density = lambda c, s: float(dist.log_interval_density_values(np.array([float(c)]), np.array([s]), 14400.0, 1.2)[0])
    want = {}
    for c, _, _, entry, leave, _ in cohorts:
        for rank, legs in ((1, [(1, 3)]), (2, [(1, 2), (2, 3)])):
            beam, kept = [((), 0.0, entry, 0.0)], 1.0
            for leg in legs:
                nxt = [(ids + (j,), s + density(d - at, (at_sd ** 2 + sd ** 2) ** 0.5), arr, sd) for ids, s, at, at_sd in beam for j, a, b, d, arr, sd in rides
                       if (a, b) == leg and at - 900 <= d <= leave + 900]
                nxt = sorted((x for x in nxt if x[1] == x[1]), key=lambda x: (-x[1], x[0]))
                total, beam = sum(np.exp(x[1]) for x in nxt), nxt[:8]
                kept *= sum(np.exp(x[1]) for x in beam) / total if beam else 1.0
            for ids, s, at, sd in beam:
                s += density(leave - at, sd) - (90 / 300.0 if rank == 2 else 0.0)
                if s == s:
                    want[c, rank, ids] = (s, kept)
    assert {(r.cohort, r.route_rank, tuple(x.ride for x in r.steps)) for r in got} == set(want)
    for r in got:
        assert want[r.cohort, r.route_rank, tuple(x.ride for x in r.steps)] == pytest.approx((r.score, r.retained), rel=1e-9)


def test_following_and_suffix_columns_of_a_large_chunk(spark):
    """60,000 rows in one chunk: a frame that ends at the chunk's last row is computed anew for every row and takes minutes."""
    n = 60_000
    rows = spark.range(n).select(F.col("id").alias("at"), F.when(F.col("id") % 1000 == 999, F.col("id")).alias("mark"), (F.col("id") * 7919 % n).alias("v")).repartition(4)
    x = skew.chunked(rows, [], ["at"], skew.span("at", n), known={"next": ("mark", True, False), "later": ("mark", True, True)}, folds={"rest": ("sum", "v", True), "least": ("min", "v", True)})
    began = time.monotonic()
    got = {r["at"]: r for r in x.collect()}
    assert time.monotonic() - began < 40
    rest, least = 0, n
    for at in range(n - 1, -1, -1):
        rest, least = rest + at * 7919 % n, min(least, at * 7919 % n)
        assert (got[at]["rest"], got[at]["least"], got[at]["next"]) == (rest, least, at // 1000 * 1000 + 999)
        assert got[at]["later"] == ((at + 1) // 1000 * 1000 + 999 if at + 1 < n else None)


def test_interpolation_at_equal_positions_follows_the_tie(spark):
    rows = [("u", 15, 5, None), ("u", 10, 3, None), ("u", 10, 2, 7.0), ("u", 10, 1, 3.0), ("u", 5, 0, None)]
    df = spark.createDataFrame(rows, "k string, s long, id long, v double").coalesce(1)
    for chunk in (skew.span("s", 100), skew.span("s", 5)):
        got = {r.id: r.o for r in S.interpolate(df, ["k"], "s", "v", chunk, "o", tie=["id"]).collect()}
        assert got == {0: 3.0, 1: 3.0, 2: 7.0, 3: 7.0, 5: 7.0}


def test_nearest_points_by_brute_force_over_all_widths(spark):
    """600 points near 3,000 targets: dense, sparse, at one place, at equal distance, outside the cap, near a pole."""
    rng = random.Random(8)
    at = lambda n, lon, lat, s: [(lon + rng.gauss(0, s), lat + rng.gauss(0, s)) for _ in range(n)]
    targets = at(2500, 3.0, 41.0, 0.05) + at(380, 3.0, 41.0, 2.0) + [(5.0, 44.0)] * 40 + at(80, 10.0, 89.5, 0.3)
    points = at(400, 3.0, 41.0, 0.3) + at(150, 3.0, 42.0, 3.0) + at(49, 10.0, 89.5, 0.3) + [(5.0, 44.0)]
    t = spark.createDataFrame([(len(targets) - i, x, y) for i, (x, y) in enumerate(targets)], "t long, lon double, lat double")
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "p long, lon double, lat double")
    want = {}
    for i, (x, y) in enumerate(points):
        tx, ty = np.radians(np.array([v[0] for v in targets])), np.radians(np.array([v[1] for v in targets]))
        d = 2 * 6371000.0 * np.arcsin(np.sqrt(np.sin((ty - np.radians(y)) / 2) ** 2 + np.cos(ty) * np.cos(np.radians(y)) * np.sin((tx - np.radians(x)) / 2) ** 2))
        near = (np.abs(np.floor(np.degrees(tx) / 2) - np.floor(x / 2)) <= 1) & (np.abs(np.floor(np.degrees(ty) / 2) - np.floor(y / 2)) <= 1)
        ok = np.flatnonzero(near & (d <= 100000))
        if len(ok):
            want[i] = min((round(d[k], 4), len(targets) - k) for k in ok)
    levels = SP._finest(t, "lon", "lat", 2.0)
    assert levels > 3
    got = {r.p: (round(r.distance_m, 4), r.t) for r in SP.nearest_point(p, "p", t, "t", "lon", "lat", 100000.0, 2.0).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["B05_scored_beam", "B21_pass_summary", "B29_timetable_consistency", "B49_raw_weight_membership"])
def test_no_row_per_chain_or_factor_is_written(spark, monkeypatch, name):
    """Chains are written as lists, one row per traveller; chains and factors as rows of their own filled the disk."""
    from ledgerline import registry
    from ledgerline.plans import load, timetable
    written, cut = [], registry.cut_lineage

    def seen(df):
        written.append(set(df.columns))
        return cut(df)
    for module in (registry, timetable, B):
        monkeypatch.setattr(module, "cut_lineage", seen)
    registry.forget_staged()
    assert load()[name](spark, "/root/testdata/sf0.001").count() >= 0
    assert written and not [c for c in written if c & {"steps", "factor", "root_chain"}]


def test_posterior_lists(spark):
    """Shares of a cohort over all its routes, and new shares after a reweighting, against plain Python."""
    step = lambda r: [(r, 1.0, 2.0)]
    rows = [(1, 5, 100, 1, 1, [(step(1), 40.0, 3.0, -2.0), (step(2), 50.0, 3.0, -2.5)]), (1, 5, 100, 2, 1, [(step(3), 60.0, 3.0, -900.0)]),
            (2, 7, 200, 1, 1, [(step(4), 150.0, 3.0, -4000.0)]), (3, 1, 9, 1, 1, [(step(5), 1.0, 3.0, -1.0), (step(0), 2.0, 3.0, -1.0)])]
    found = spark.createDataFrame(rows, f"cohort long, mass long, exit long, route_rank int, legs int, chains array<{B._CHAIN}>")
    post = B.reweight(B.posterior(found, "cohort"), lambda c: F.when(c["steps"][0]["ride"] > 0, -c["steps"][0]["ride"] * 1.0))
    got = {(r.cohort, r.steps[0].ride): r for r in B.chains_of(post, "cohort").collect()}
    a, b, c = 1.0, np.exp(-0.5), np.exp(-898.0)
    x, y = np.exp(-1.0), np.exp(-0.5) * np.exp(-2.0)
    want = {(1, 1): (a / (a + b + c), x / (x + y)), (1, 2): (b / (a + b + c), y / (x + y)), (1, 3): (0.0, 0.0), (2, 4): (1.0, 1.0), (3, 5): (0.5, 0.5), (3, 0): (0.5, 0.5)}
    assert set(got) == set(want)
    for k, v in want.items():
        assert (got[k].p, got[k].new_p) == pytest.approx(v, abs=1e-12)
    assert got[1, 2].egress_centre == 50.0 and got[1, 2].mass == 5
    top = {r.cohort: r for r in B.route_summary(post, "cohort").collect()}
    assert (top[1].top_route, top[2].entropy, top[3].top_chain_p) == (1, pytest.approx(0.0), pytest.approx(0.5))


def test_time_lines_read_written_rides(spark):
    """The lookups of anchors and directions read what was written once, not the order lines or all transfers over and over."""
    from ledgerline.plans import load
    anchors = load()["B38_anchor_check"](spark, "/root/testdata/sf0.001")
    assert not [f for f in anchors.inputFiles() if "lineitem" in f]
    directions = load()["B40_directional_transfer_evidence"](spark, "/root/testdata/sf0.001")
    assert set(spark.read.parquet(*directions.inputFiles()).columns) == {"station", "dest", "upper", "n"}


def test_offsets_of_a_lineage_are_written_once_and_match_brute_force(spark):
    rng = random.Random(30)
    children = [(rng.randrange(2), rng.randrange(400), i) for i in range(80)]
    parents = [(rng.randrange(2), rng.randrange(400), i) for i in range(30)]
    ddl = "station int, s long, event_id long"
    out = V.offset_lineage(spark.createDataFrame(children, ddl), spark.createDataFrame(parents, ddl), ["station"], "s", "event_id", ["station"], 20, 50)
    want = {}
    for station, s, _ in children:
        near = min(((abs(p - s), i, s - p) for st, p, i in parents if st == station and abs(p - s) <= 20), default=None)
        if near:
            want.setdefault(station, []).append(near[2])
    want = {k: (float(np.median(v)), float(np.median(np.abs(np.array(v) - np.median(v)))), len(v)) for k, v in want.items()}
    assert {r.station: (r.med, r.mad, r.n) for r in out.collect()} == want
    assert "__pt" not in out._jdf.queryExecution().optimizedPlan().toString()


def _riders_and_rides(spark, seed):
    rng = random.Random(seed)
    riders = [(i, rng.randrange(2), 1, e, e + rng.randrange(-5, 90), rng.randrange(1, 4)) for i, e in enumerate(rng.randrange(600) for _ in range(60))]
    trains = [(i, rng.randrange(2), 1, d, d + rng.randrange(1, 30)) for i, d in enumerate(rng.randrange(700) for _ in range(150))]
    return (riders, trains, spark.createDataFrame(riders, "cohort long, from_station int, to_station int, entry long, exit long, mass long"),
            spark.createDataFrame(trains, "ride_id long, from_station int, to_station int, dep long, arr long"))


def _log_density(x, median, sigma):
    return -np.log(x * sigma * np.sqrt(2 * np.pi)) - 0.5 * ((np.log(x) - np.log(median)) / sigma) ** 2


@pytest.mark.parametrize("block", [7, 500_000])
def test_bootstrap_takes_the_best_ride_of_each_cohort_without_writing_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(TT, "PAIR_BLOCK", block)
    written = []
    monkeypatch.setattr(TT, "cut_lineage", lambda df: written.append(df.count()) or df)
    riders, trains, c, r = _riders_and_rides(spark, 46)
    out = {(x["round"], x.factor): (x.median, x.sigma) for x in TT.bootstrap_kernels(c, r, ["from_station", "to_station"], (30.0, 1.2), 2, width=100).collect()}
    access = egress = (30.0, 1.2)
    for n in (1, 2):
        best = []
        for _, f, to, entry, leave, mass in riders:
            met = [(-round(_log_density(d - entry, *access) + _log_density(leave - a, *egress), 9), i, d - entry, leave - a) for i, rf, rt, d, a in trains if (rf, rt) == (f, to) and entry < d <= leave and a < leave]
            if met:
                best.append((mass, *min(met)[2:]))
        m, g, e = (np.array(x, float) for x in zip(*best, strict=True))
        fit = lambda x: (np.exp((m * np.log(x)).sum() / m.sum()), min(2.5, max(0.12, np.sqrt((m * np.log(x) ** 2).sum() / m.sum() - ((m * np.log(x)).sum() / m.sum()) ** 2))))  # noqa: B023, E731
        access, egress = fit(g), fit(e)
        assert np.allclose(out[n, "access"], access) and np.allclose(out[n, "egress"], egress)
    assert max(written) <= len(trains)


def test_schedule_scan_matches_brute_force_and_forms_no_pairs(spark):
    riders, trains, c, r = _riders_and_rides(spark, 47)
    shifts, horizon = [-40, 0, 25], 60
    out = TT.schedule_scan(r.drop("arr"), c, ["from_station", "to_station"], shifts, horizon, 20.0, 0.9, width=50)
    want = {}
    for i, f, to, d, _ in trains:
        found = []
        for s in shifts:
            met = [(m, d + s - e) for _, rf, rt, e, _, m in riders if (rf, rt) == (f, to) and 0 < d + s - e <= horizon]
            if met:
                mass = sum(m for m, _ in met)
                found.append((-round(sum(m * _log_density(g, 20.0, 0.9) for m, g in met) / mass, 9), abs(s), s, mass))
        if found:
            want[i] = (max(x[3] for x in found), min(found)[2], abs(min(found)[2]))
    assert {x.ride_id: (x.mass, x.best_shift, x.abs_error) for x in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_missing_indices_come_from_bitmaps(spark):
    from ledgerline.operators.reconcile import missing_indices
    present = [None, -3, 1, 1, 2, 32766, 32768, 100_001, 100_003]
    found = missing_indices(spark.createDataFrame([(i,) for i in present], "i long"), "i")
    assert sorted(r.missing for r in found.collect()) == sorted(set(range(100_004)) - set(present))
    assert "Join LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert missing_indices(spark.createDataFrame([], "i long"), "i").count() == 0


def test_anti_join_keeps_cells_and_sends_only_suppliers_that_can_meet_them(spark, tmp_path):
    from ledgerline.plans import load
    spark.sql("SELECT DATE'2000-01-01' AS l_shipdate, explode(array(7L, 107L, -8L, NULL)) AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT DATE'2000-01-01' AS o_orderdate, explode(array(7L, 207L, 5L, -108L, NULL)) AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    out = load()["J05_anti_join"](spark, str(tmp_path))
    assert {r.k: (r.demand, r.supplied) for r in out.collect()} == {7: (2, True), 5: (1, False), -8: (1, True), None: (1, False)}
    assert "99" in out._jdf.queryExecution().optimizedPlan().toString()


def test_turnback_queries_read_the_rides_once(spark, monkeypatch):
    from ledgerline.plans import audits, load
    from ledgerline.registry import forget_staged
    forget_staged()
    made, rides = [], audits.rides
    monkeypatch.setattr(audits, "rides", lambda t: made.append(t) or rides(t))
    load()["V11_turnback_sensitivity"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_completion_of_variants_writes_trips_not_their_nodes(spark, monkeypatch):
    written, cut = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    ev = spark.createDataFrame([(k, k % 2, p, 100.0 * p + k) for k in range(6) for p in (3, 9)], "trip long, line long, pos long, t double")
    va = spark.createDataFrame([(ln, 0, i, i, float(i)) for ln in range(2) for i in range(25)], "line long, variant int, i long, node long, cum double")
    out = S.complete_variants(ev, va, "trip", "line", "pos", "t", 15.0).collect()
    assert len(out) == 6 * 25 and all(r.filled == 100.0 * r.pos + r.trip for r in out if r.role in ("ORIGINAL", "BETWEEN_OBSERVED_ANCHORS"))
    assert max(w.count() for w in written) <= 6


def _dense_legs(seed):
    rng = random.Random(seed)
    riders = [(i, 1, 3, e, e + rng.choice([-5000, 0, 3000, 20_000, 60_000]), 1 + i % 3) for i, e in enumerate(rng.randrange(0, 200_000) for _ in range(80))]
    trains = [(j, a, b, d, d + rng.choice([0, 300, 900, -400]), 10.0 + j % 20) for j, (a, b, d) in enumerate((rng.choice([(1, 3), (1, 2), (2, 3)]) + (rng.randrange(0, 260_000),)) for _ in range(2500))]
    routes = [(1, 3, 1, 1, 1, 1, 3, 0.0), (1, 3, 2, 2, 1, 1, 2, 90.0), (1, 3, 2, 2, 2, 2, 3, 90.0)]
    return riders, trains, routes


@pytest.mark.parametrize("kernel", [(14400.0, 1.2), (600.0, 0.4), (40.0, 2.0)])
def test_chains_scored_around_the_mode_are_those_of_all_rides(monkeypatch, kernel):
    """Rides away from the mode are scored only while they could reach the beam: the chains stay those of all pairs, for few pairs."""
    import pyarrow as pa
    riders, trains, _ = _dense_legs(36)
    pair = lambda a, b: a << 32 | b
    left = pa.table({"cohort": [r[0] for r in riders for _ in "ab"], "entry": [r[3] for r in riders for _ in "ab"], "exit": [r[4] for r in riders for _ in "ab"], "mass": [r[5] for r in riders for _ in "ab"],
                     "route_rank": [1, 2] * 80, "legs": [1, 2] * 80, "extra": [0.0, 90.0] * 80, "__pair1": [pair(1, 3), pair(1, 2)] * 80, "__pair2": pa.array([None, pair(2, 3)] * 80, pa.int64())})
    right = pa.table({"__pair": [pair(a, b) for _, a, b, _, _, _ in trains], **{n: [x[i] for x in trains] for n, i in (("ride_id", 0), ("dep", 3), ("arr", 4), ("sd", 5))}})
    kernels, scored, density = {k: kernel for k in ("access", "transfer", "egress")}, [], dist.log_interval_density_values
    monkeypatch.setattr(dist, "log_interval_density_values", lambda c, *a: scored.append(len(c)) or density(c, *a))
    monkeypatch.setattr(B, "_NEAR", 2)
    found = []
    for all_mass in (True, False):
        scored.clear()
        x = B._chains(2, kernels, 8, all_mass, left, right)
        found.append(({(int(r), *x.ride_id[k[k >= 0]]): (round(s, 9), round(p, 9)) for r, k, s, p in zip(x.row, x.k, x.score, x.p, strict=True)}, sum(scored)))
    assert found[0][0] == found[1][0] and len(found[0][0]) > 100
    if kernel[0] == 14400.0:
        assert found[1][1] < found[0][1]


def test_posteriors_do_not_depend_on_the_groups(spark, monkeypatch):
    """Spans of time and splits by station pair give the same chains, and only rides and routes are written."""
    riders, trains, routes = _dense_legs(18)
    riders += [(900, 1, 3, None, 5, 1), (901, 7, 8, 10, 20, 2), (902, 2, 3, 5000, 90_000, 1)]
    routes += [(2, 3, 1, 1, 1, 2, 3, 0.0)]
    args = (spark.createDataFrame(riders, "cohort long, from_station int, to_station int, entry long, exit long, mass long"),
            spark.createDataFrame(routes, "from_station int, to_station int, route_rank int, legs int, leg_no int, leg_from int, leg_to int, cost double"),
            spark.createDataFrame(trains, "ride_id long, from_station int, to_station int, dep long, arr long, sd double"), {k: (14400.0, 1.2) for k in ("access", "transfer", "egress")}, 8)
    want = {(r.cohort, tuple(x.ride for x in r.steps)): round(r.p, 9) for r in B.chains_of(B.posterior(B.beams(*args, 10 ** 9), "cohort"), "cohort").collect()}
    written, cut = [], B.cut_lineage
    monkeypatch.setattr(B, "cut_lineage", lambda df: written.append(set(df.columns)) or cut(df))
    for most in (B._GROUP_ROWS, 60):
        monkeypatch.setattr(B, "_GROUP_ROWS", most)
        monkeypatch.setattr(B, "_LEAST_ROWS", 20)
        post = B.posteriors(*args, 10 ** 9)
        assert {(r.cohort, tuple(x.ride for x in r.steps)): round(r.p, 9) for r in B.chains_of(post, "cohort").collect()} == want
        lines = B.lineage(post).collect()
        assert sorted(r.cohort for r in lines if r.unresolved_reason) == sorted({r[0] for r in riders} - {c for c, _ in want})
        assert sum(r.lineage_mass for r in lines) == pytest.approx(sum(r[5] for r in riders))
    assert not [c for c in written if c & {"cohort", "chains"}]


@pytest.mark.parametrize("name", ["B11_lineage_aggregates", "B13_factor_histograms", "B14_kernel_statistics", "B18_shift_grid", "B28_chain_reweight", "B33_soft_order_objective", "B36_sparse_update_proposal"])
def test_no_beam_or_posterior_is_written(spark, monkeypatch, name):
    from ledgerline import registry
    from ledgerline.plans import load, timetable
    written, cut = [], registry.cut_lineage
    for module in (registry, timetable, B):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(set(df.columns)) or cut(df))
    registry.forget_staged()
    assert load()[name](spark, "/root/testdata/sf0.001").count() >= 0
    assert written and not [c for c in written if c & {"chains", "steps", "factor", "shift"}]


def test_sums_of_factors_match_the_factors_as_rows(spark):
    """Sums made inside the groups against the same sums over one row per factor."""
    riders, trains, routes = _dense_legs(33)
    scoring = (spark.createDataFrame(riders, "cohort long, from_station int, to_station int, entry long, exit long, mass long"),
               spark.createDataFrame(routes, "from_station int, to_station int, route_rank int, legs int, leg_no int, leg_from int, leg_to int, cost double"),
               spark.createDataFrame(trains, "ride_id long, from_station int, to_station int, dep long, arr long, sd double"), {k: (14400.0, 1.2) for k in ("access", "transfer", "egress")}, 8, 86400)
    rows = [r.asDict() for r in B.factors(B.posteriors(*scoring)).collect()]
    pairs, shifts, usage, cells = {}, {}, {}, {}
    for r in rows:
        key = (r["factor"], r["lower_root"], r["upper_root"])
        pairs[key] = pairs.get(key, 0) + 1
        for root, sign in ((r["upper_root"], 1), (r["lower_root"], -1)):
            if root is not None:
                usage[root] = usage.get(root, 0.0) + r["w"]
                for s in (-1800, 0):
                    ll = float(dist.log_interval_density_values(np.array([r["centre"] + sign * s]), np.array([r["sd"]]), 14400.0, 1.2)[0])
                    shifts[root, s] = shifts.get((root, s), 0.0) + r["w"] * (-1e6 if np.isnan(ll) else ll)
        if r["centre"] > 0:
            cells[r["factor"]] = cells.get(r["factor"], 0.0) + r["w"] * np.log(r["centre"])
    assert {(r.factor, r.lower_root, r.upper_root): r.n for r in B.factor_pairs(scoring).withColumn("factor", B.factor_name()).collect()} == pairs
    got = B.shift_scores(scoring, [-1800, 0]).collect()
    assert {r.root: pytest.approx(r.usage) for r in got} == usage
    assert {(r.root, x.shift): pytest.approx(x.score) for r in got for x in r.scores} == shifts
    assert {r.factor: pytest.approx(r.sum_log) for r in B.log_sums(scoring).withColumn("factor", B.factor_name()).collect()} == cells
    clear = B.clear_shifts(spark.createDataFrame([(1, 1.0, [(-1, 5.0), (0, 1.0), (1, 5.0)]), (2, 1.0, [(-2, 5.0), (-1, 5.0), (0, 1.0)]), (3, 0.1, [(0, 1.0), (1, 9.0)]), (4, 1.0, [(0, 1.0), (1, 1.0)])],
                                                 "root long, usage double, scores array<struct<shift:int,score:double>>"), 1e9, 0.01, 0.2).collect()
    assert [(r.root, r.shift, r.gain) for r in clear] == [(2, -1, 4.0)]


@pytest.mark.parametrize("block", [40, 500_000])
def test_hazard_beams_match_a_sequential_fold_and_write_no_pairs(spark, monkeypatch, block):
    written, cut = [], TT.cut_lineage
    monkeypatch.setattr(TT, "cut_lineage", lambda df: written.append(df.count()) or cut(df))
    riders, trains, c, r = _riders_and_rides(spark, 52)
    monkeypatch.setattr(TT, "PAIR_BLOCK", block)
    cdf = lambda x: float(dist.normal_cdf_values(np.array([(np.log(x) - np.log(30.0)) / 1.2]))[0])
    want = {}
    for i, f, _, entry, leave, _ in riders:
        s, before, found = 0.0, 0.0, []
        for d, j, a in sorted((d, j, a) for j, rf, _, d, a in trains if rf == f and entry + 5 <= d <= leave):
            s, before = 0.2 * s + max(0.0, cdf(d - entry) - before), cdf(d - entry)
            if leave - a >= 3:
                found.append((-(np.log(max(0.8 * s, 1e-12)) + _log_density(leave - a, 30.0, 1.2)), j, 0.8 * s))
        want.update({(i, j): (b, -v) for v, j, b in sorted(found)[:4]})
    left, right = ({n: df.select(n).toPandas()[n].to_numpy() for n in df.columns} for df in (c, r))
    import pyarrow as pa
    tables = pa.table({**left, "__b": np.zeros(len(riders), "int64")}), pa.table({**{n: right[n] for n in ("ride_id", "from_station", "arr")}, "__at": right["dep"], "__b": np.zeros(len(trains), "int64")})
    direct = TT._hazard_beams(["from_station"], (30.0, 1.2), 0.2, 4, 5, 3)(*tables).to_pylist()
    rows = [x.asDict() for x in TT.hazard_beams(c, r, ["from_station"], (30.0, 1.2), 0.2, 4, 5, 3, width=100).collect()]
    for got in (direct, rows):
        assert {(x["cohort"], x["ride_id"]): (pytest.approx(x["boarding"], rel=1e-9, abs=1e-15), pytest.approx(x["score"], rel=1e-9)) for x in got} == want
    assert max(written) <= len(trains)


@pytest.mark.parametrize("pairs", [48_000_000, 500])
def test_points_in_polygons_by_brute_force_without_shuffled_pairs(spark, monkeypatch, pairs):
    """Polygons of three to six corners, one of them concave, points without a place; pairs are tested in their cell, not grouped afterwards."""
    monkeypatch.setattr(SP, "_GROUP_PAIRS", pairs)
    rng = random.Random(17)
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(300)] + [(300, None, 1.0), (301, 0.25, 0.5)]
    rings = {j: [(cx + r * np.cos(a), cy + r * np.sin(a)) for a in sorted(rng.uniform(0, 6.28) for _ in range(rng.randrange(3, 7)))] for j in range(60) for cx, cy, r in [(rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(0.1, 2))]}
    rings[60] = [(-2.0, -2.0), (2.0, -2.0), (0.0, -1.0), (2.0, 2.0), (-2.0, 2.0)]
    edges = [(j, *map(float, a), *map(float, b)) for j, ring in rings.items() for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    want = set()
    for i, x, y in points[:300] + points[301:]:
        for j in rings:
            if sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for k, x1, y1, x2, y2 in edges if k == j) % 2:
                want.add((i, j))
    out = SP.points_in_polygons(spark.createDataFrame(points, "p long, x double, y double"), "p", "x", "y", spark.createDataFrame(edges, "z int, x1 double, y1 double, x2 double, y2 double"), "z", 1.0)
    rows = out.collect()
    assert len(rows) == len(want) > 100 and {(r.p, r.z) for r in rows} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("FlatMapCoGroups")


@pytest.mark.parametrize("name", ["B24_first_boardable_likelihood", "B25_movement_fit"])
def test_episodes_meet_the_rides_of_their_search_only(spark, monkeypatch, tmp_path, name):
    """A busy station: buckets as long as the mean search, not four hours, so that episodes meet few rides outside of it."""
    from ledgerline.plans import assign, load
    spark.range(3000).selectExpr("id + 1 AS l_orderkey", "1L AS l_linenumber", "id % 25 AS l_suppkey", "id AS l_partkey", "1.0D AS l_quantity", "TIMESTAMP_NTZ'2000-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    met, join = [], assign.J.interval_join

    def counted(left, right, keys, lo, hi, at, width):
        b = lambda c: F.floor(F.col(c) / width)
        pairs = left.withColumn("__b", F.explode(F.sequence(b(lo), b(hi)))).join(right.withColumn("__b", b(at)), [*keys, "__b"]).count()
        met.append((pairs, left.count()))
        return join(left, right, keys, lo, hi, at, width)
    monkeypatch.setattr(assign.J, "interval_join", counted)
    assert load()[name](spark, str(tmp_path)).count() > 0
    assert met and all(0 < rows and pairs <= 8 * rows for pairs, rows in met)
