"""Skew-safe primitives against plain Python, with chunk widths that cut the data everywhere."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.operators import quantiles as Q
from ledgerline.operators import topk as K


def rows(n, seed, keys=3, span=200):
    r = random.Random(seed)
    return [(r.randrange(keys) if r.random() > 0.4 else 0, r.randrange(span), i, r.choice([None, r.randrange(50)])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_chunked_equals_plain_order(spark, width):
    data = rows(300, width)
    df = spark.createDataFrame(data, "k int, t int, i int, v int")
    got = skew.chunked(df, ["k"], ["t", "i"], skew.span("t", width), near={"p": (["i"], False), "n": (["i"], True)},
                       known={"last": ("v", False, False), "after": ("v", True, True)}, folds={"run": ("sum", "i", False), "tail": ("max", "i", True)}, totals={"all": ("sum", "i")}).collect()
    for k in {d[0] for d in data}:
        seq = sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]))
        mine = sorted((g for g in got if g.k == k), key=lambda g: (g.t, g.i))
        assert [m.i for m in mine] == [s[2] for s in seq]
        total, run = sum(s[2] for s in seq), 0
        for j, (s, m) in enumerate(zip(seq, mine)):
            run += s[2]
            assert (m.p.i if m.p else None) == (seq[j - 1][2] if j else None)
            assert (m.n.i if m.n else None) == (seq[j + 1][2] if j + 1 < len(seq) else None)
            seen = [x[3] for x in seq[:j + 1] if x[3] is not None]
            ahead = [x[3] for x in seq[j + 1:] if x[3] is not None]
            assert m["last"] == (seen[-1] if seen else None) and m.after == (ahead[0] if ahead else None)
            assert m.run == run and m.tail == max(x[2] for x in seq[j:]) and m["all"] == total


@pytest.mark.parametrize("width", [1, 9, 1000])
def test_islands(spark, width):
    data = rows(250, width + 50)
    df = spark.createDataFrame(data, "k int, t int, i int, v int")
    got = skew.islands(df, ["k"], ["t", "i"], skew.span("t", width), ["t"], lambda p, c: c["t"] - p["t"] <= 2, "isl").collect()
    for k in {d[0] for d in data}:
        seq = sorted((g for g in got if g.k == k), key=lambda g: (g.t, g.i))
        n = 0
        for j, g in enumerate(seq):
            n += j == 0 or g.t - seq[j - 1].t > 2
            assert g.isl == n


def test_quantile_kinds(spark):
    r = random.Random(3)
    data = [(k, float(r.randrange(40)) + r.choice([0, 0.25, 0.5]), float(1 + r.randrange(5))) for k in (0, 0, 0, 1, 2) for _ in range(37 if k else 60)] + [(7, 4.0, 2.0)]
    df = spark.createDataFrame(data, "k int, v double, w double")
    pts = {"a": 0.1, "b": 0.5, "c": 0.9}
    res = {kind: {x.k: x for x in Q.quantiles(df, ["k"], "v", 3.0, pts, kind=kind).collect()} for kind in ("linear", "nearest", "floor", "ceil")}
    res["weighted"] = {x.k: x for x in Q.quantiles(df, ["k"], "v", 3.0, pts, kind="weighted", weight="w").collect()}
    for k in {d[0] for d in data}:
        vals = sorted(d[1] for d in data if d[0] == k)
        n = len(vals)
        for name, p in pts.items():
            q = Fraction(p)
            assert res["linear"][k][name] == pytest.approx(np.quantile(vals, p))
            assert res["nearest"][k][name] == vals[round((n - 1) * p)]
            assert res["floor"][k][name] == vals[int((n - 1) * p)]
            assert res["ceil"][k][name] == vals[max(0, int(np.ceil(n * p)) - 1)]
            cum, tot = 0.0, sum(d[2] for d in data if d[0] == k)
            for v, w in sorted((d[1], d[2]) for d in data if d[0] == k):
                cum += w
                if cum >= tot * p:
                    assert res["weighted"][k][name] == v
                    break
            assert q


@pytest.mark.parametrize("seed", [1, 2])
def test_suppression_is_sequential_greedy(spark, seed):
    r = random.Random(seed)
    data = [(r.randrange(2), r.randrange(400), i, r.randrange(20)) for i in range(150)]
    df = spark.createDataFrame(data, "k int, t int, i int, s int")
    got = {x.i for x in K.suppress(df, ["k"], "t", [-F.col("s"), F.col("i")], 7, 16).collect()}
    kept = []
    for d in sorted(data, key=lambda d: (-d[3], d[2])):
        if all(d[0] != o[0] or abs(d[1] - o[1]) >= 7 for o in kept):
            kept.append(d)
    assert got == {d[2] for d in kept}


def test_greedy_matching_is_sequential(spark):
    r = random.Random(5)
    pairs = list({(r.randrange(15), r.randrange(15)): None for _ in range(90)})
    data = [(a, b, r.randrange(30)) for a, b in pairs]
    df = spark.createDataFrame(data, "a int, b int, c int")
    got = {(x.a, x.b) for x in K.greedy_match(df, [], "a", "b", [F.col("c"), F.col("a"), F.col("b")]).collect()}
    used_a, used_b, want = set(), set(), set()
    for a, b, c in sorted(data, key=lambda d: (d[2], d[0], d[1])):
        if a not in used_a and b not in used_b:
            want.add((a, b)); used_a.add(a); used_b.add(b)
    assert got == want
