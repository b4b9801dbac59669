"""Residual replay against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import dist
from ledgerline.operators import assign as B
from ledgerline.operators import replay as RP

ACCESS, TRANSFER = [(0.7, 600.0, 0.8), (0.3, 1800.0, 1.1)], [(0.6, 300.0, 0.9), (0.4, 900.0, 1.0)]
BEAM, SKIPS, UPPER = 3, 2, 36_000.0


def erf(x):
    t = 1 / (1 + dist.ERF_P * abs(x))
    poly = 0.0
    for a in reversed(dist.ERF_A):
        poly = (poly + a) * t
    return math.copysign(1, x) * (1 - poly * math.exp(-x * x)) if x else 0.0


def cdf(x, kernel):
    return sum(w * 0.5 * (1 + erf((math.log(x) - math.log(m)) / s / math.sqrt(2))) for w, m, s in kernel) if x > 0 else 0.0


def expected(mean, sd, kernel):
    return cdf(mean, kernel) if sd <= 1e-9 else sum(w * cdf(mean + z * sd, kernel) for z, w in zip(dist.GH_NODES, dist.GH_WEIGHTS, strict=True))


def quantile(kernel, q):
    lo, hi = 0.0, UPPER
    for _ in range(70):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if cdf(mid, kernel) < q else (lo, mid)
    return 0.5 * (lo + hi)


@pytest.fixture(scope="module")
def world():
    rng = random.Random(21)
    routes, rides, cohorts = [], [], []
    for od in range(6):
        for rank in (1, 2, 3, 4):
            for leg in range(1, rank + 1):
                a, b = 100 * od + 10 * rank + leg, 100 * od + 10 * rank + leg + 1
                routes.append((od, od + 50, rank, rank, leg, a, b, 5.0 + rank))
                if rng.random() < 0.75:  # the others have no rides at all
                    for _ in range(rng.randrange(1, 7)):
                        dep = rng.randrange(0, 8000)
                        rides.append((len(rides), a, b, dep, dep + rng.randrange(60, 900), float(rng.randrange(0, 30))))
    for c in range(80):
        od, entry = rng.randrange(6), rng.randrange(0, 5000)
        cohorts.append((c, od, od + 50, entry, entry + rng.randrange(200, 6000), 1 + c % 3))
    cohorts.append((999, 77, 78, 0, 100, 1))  # no route
    return routes, rides, cohorts


def frames(spark, world):
    routes, rides, cohorts = world
    return (spark.createDataFrame(cohorts, "cohort long, from_station int, to_station int, entry long, exit long, mass long"),
            spark.createDataFrame(routes, "from_station int, to_station int, route_rank int, legs int, leg_no int, leg_from int, leg_to int, cost double"),
            spark.createDataFrame(rides, "ride_id long, from_station int, to_station int, dep long, arr long, sd double"))


def brute_failure(legs, by_leg, exit_):
    for no, a, b in legs:
        gates = [(arr - 3 * max(1.0, sd), i) for i, dep, arr, sd in by_leg.get((a, b), [])]
        if not gates:
            return "MISSING_SERVICE_SEGMENT", no, None, None
        if min(gates)[0] > exit_:
            return "TIME_INCOMPATIBLE_CHAIN", no, min(gates)[1], min(gates)[0] - exit_
    return "FINITE_HARD_CHAIN_EXISTS", None, None, None


def brute_envelope(legs, by_leg, entry, exit_, stop):
    states = [(float(entry), 0.0, 0.0)]
    for no, a, b in legs:
        kernel = ACCESS if no == 1 else TRANSFER
        if no == stop:
            top = max(s[2] for s in states)
            p = [math.exp(s[2] - top) for s in states]
            mean = sum(x * (s[0] - entry) for x, s in zip(p, states, strict=True)) / sum(p)
            return len(states), min(s[0] for s in states) - entry + quantile(kernel, 0.05), mean + quantile(kernel, 0.5), max(s[0] for s in states) - entry + quantile(kernel, 0.95)
        rides, found = sorted(by_leg[a, b], key=lambda r: (r[1], r[0])), []
        for ready, sd0, logp in states:
            for i, (rid, _, arr, sd) in enumerate(rides):
                if arr - 3 * max(1.0, sd) > exit_:
                    continue
                options = min(SKIPS + 1, i + 1)
                for skip in range(options):
                    up, low = rides[i - skip], rides[i - skip - 1] if i - skip > 0 else None
                    prob = expected(up[1] - ready, math.hypot(up[3], sd0), kernel) - (expected(low[1] - ready, math.hypot(low[3], sd0), kernel) if low else 0.0)
                    if prob > RP.LEAST_PROBABILITY:
                        found.append((-round(logp + math.log(prob) - math.log(options), 9), arr, rid, skip, sd))
        if not found:
            return None
        states = [(float(arr), sd, -minus) for minus, arr, _, _, sd in sorted(found)[:BEAM]]


def test_failures_and_envelopes_at_any_depth(spark, world):
    routes, rides, cohorts = world
    by_leg, legs_of = {}, {}
    for rid, a, b, dep, arr, sd in rides:
        by_leg.setdefault((a, b), []).append((rid, dep, arr, sd))
    for f, t, rank, _, no, a, b, _ in sorted(routes):
        legs_of.setdefault((f, t), {}).setdefault(rank, []).append((no, a, b))
    c, r, s = frames(spark, world)
    failures = RP.route_failures(c, r, s)
    want = {(k, rank): brute_failure(legs, by_leg, exit_) for k, f, t, entry, exit_, _ in cohorts for rank, legs in legs_of.get((f, t), {}).items()}
    got = {(x.cohort, x.route_rank): (x.reason, x.leg_no, x.closest, x.excess) for x in failures.collect()}
    assert got == want and {x[0] for x in want.values()} == {"MISSING_SERVICE_SEGMENT", "TIME_INCOMPATIBLE_CHAIN", "FINITE_HARD_CHAIN_EXISTS"}
    out = RP.replay(failures, r, RP.boarding_options(s, SKIPS, 1000.0), ACCESS, TRANSFER, BEAM, UPPER).collect()
    times = {k: (entry, exit_, f, t) for k, f, t, entry, exit_, _ in cohorts}
    deepest = 0
    assert len(out) == sum(x[1] is not None for x in want.values())
    for x in out:
        entry, exit_, f, t = times[x.cohort]
        env = brute_envelope(legs_of[f, t][x.route_rank], by_leg, entry, exit_, x.leg_no)
        if env is None:
            assert x.n_states is None and x.q50 is None
        else:
            deepest = max(deepest, x.leg_no)
            assert x.n_states == env[0] and (x.q05, x.q50, x.q95) == pytest.approx(env[1:], abs=1e-5)
    assert deepest >= 3


def test_cohorts_without_a_route_fail_with_a_row(spark, world):
    c, r, s = frames(spark, world)
    x = B.earliest_chains(c, r, s, 1000.0).where("cohort = 999").collect()
    assert len(x) == 1 and x[0].reason == "ROUTE_HAS_NO_RIDE_LEGS" and not x[0].ok and x[0].route_rank is None
    assert B.choose_chain(B.earliest_chains(c, r, s, 1000.0), "cohort").count() == c.count()


def test_support_equals_all_pairs(spark):
    rng = random.Random(33)
    services = [(k, i, d := rng.randrange(0, 900), d + rng.randrange(1, 200)) for i in range(60) for k in (1, 2)]
    records = []
    for _ in range(150):
        q = sorted(rng.uniform(0, 900) if rng.random() < 0.7 else float(rng.randrange(0, 900)) for _ in range(3))
        records.append((rng.choice([1, 1, 1, 3]), *q, rng.randrange(0, 1100), rng.randrange(1, 9)))
    records += [(1, 100.0, 100.0, 100.0, 200, 5)] * 2
    services += [(1, 900, 100, 200), (1, 901, 100, 201), (1, 902, 99, 200)]
    out = RP.service_support(spark.createDataFrame(services, "seg int, ride_id long, dep long, arr long"), spark.createDataFrame(records, "seg int, q05 double, q50 double, q95 double, exit long, mass long"), ["seg"], 100.0).collect()
    got = {(x.seg, x.ride_id): (x.exit_mass, x.q05_mass, x.q50_mass, x.q95_mass, x.q05_cohorts, x.q50_cohorts, x.q95_cohorts) for x in out}
    for k, i, dep, arr in services:
        mine = [r for r in records if r[0] == k]
        fits = [[r for r in mine if r[q] <= dep and arr <= r[4]] for q in (1, 2, 3)]
        assert got[k, i] == (sum(r[5] for r in mine if arr <= r[4]), *(sum(r[5] for r in f) for f in fits), *map(len, fits)), (k, i)
    assert len(got) == len(services)


def test_mixture_quantile_inverts_the_cdf(spark):
    for q in (0.05, 0.5, 0.95):
        x = spark.range(1).select(dist.mixture_quantile(ACCESS, q, UPPER)).first()[0]
        assert x == pytest.approx(quantile(ACCESS, q), rel=1e-9)
        assert spark.range(1).select(dist.mixture_cdf(F.lit(x), ACCESS)).first()[0] == pytest.approx(q, abs=1e-6)


def test_replay_writes_no_pairs_and_does_not_depend_on_the_groups(spark, world, monkeypatch):
    """Only rides and routes are written, in spans of time of any length and any number of splits; chunks of the options cut through their neighbours."""
    routes, rides, cohorts = world
    c, r, s = frames(spark, world)
    failures = RP.route_failures(c, r, s).localCheckpoint()
    written, cut = [], RP.cut_lineage
    monkeypatch.setattr(RP, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    found = []
    for most, chunk in ((B._GROUP_ROWS, 10 ** 6), (20, 50.0)):
        monkeypatch.setattr(B, "_GROUP_ROWS", most)
        monkeypatch.setattr(B, "_LEAST_ROWS", 10)
        out = RP.replay(failures, r, RP.boarding_options(s, SKIPS, chunk), ACCESS, TRANSFER, BEAM, UPPER, 100)
        found.append({(x.cohort, x.route_rank): (x.n_states, *[None if v is None else round(v, 6) for v in (x.q05, x.q50, x.q95)]) for x in out.collect()})
    assert found[0] == found[1] and len(found[0]) > 100 and any(v[0] == BEAM for v in found[0].values())
    assert written and not [w for w in written if "cohort" in w.columns] and max(w.count() for w in written) <= len(rides) * 2
