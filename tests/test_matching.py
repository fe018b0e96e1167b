"""Matching in two measures against plain loops."""

import hashlib
import math
import random

import pytest

from tidemark.operators import matching as M


def sample(seed, n=25, m=120):
    rng = random.Random(seed)
    value = lambda: rng.choice([0.0, None, *[round(math.exp(rng.gauss(3, 0.5)), 2) for _ in range(12)]])
    events = [(k, rng.choice("ab"), rng.randint(0, 1_000), value(), value()) for k in range(n)]
    bars = [(rng.choice("abc"), t, value(), value()) for t in rng.sample(range(1_000), m)]
    return events, bars


def frames(spark, events, bars):
    return spark.createDataFrame(events, "event_id long, symbol string, ts_ms long, x double, z double"), spark.createDataFrame(bars, "symbol string, ts_ms long, x double, z double").repartition(3)


def near(e, b, fx=1.5, fz=3.0, gap=50):
    ok = e[1] == b[0] and abs(e[2] - b[1]) > gap and all(v is not None and v > 0 for v in (e[3], e[4], b[2], b[3]))
    return ok, ok and max(e[3], b[2]) <= min(e[3], b[2]) * fx, ok and max(e[4], b[3]) <= min(e[4], b[3]) * fz


@pytest.mark.parametrize("seed", [1, 2])
def test_rungs_and_pairs(spark, seed):
    events, bars = sample(seed)
    ev, br = frames(spark, events, bars)
    got = {r.event_id: (r.n_bars, r.n_gap, r.n_key, r.n_x, r.n_both) for r in M.rungs(ev, br, "x", "z", 1.5, 3.0, 50).collect()}
    for e in events:
        mine = [b for b in bars if b[0] == e[1]]
        good = [b for b in mine if abs(e[2] - b[1]) > 50]
        key = [b for b in good if b[2] and b[3] and b[2] > 0 and b[3] > 0]
        x = [b for b in key if near(e, b)[1]]
        assert got[e[0]] == (len(mine), len(good), len(key), len(x), sum(near(e, b)[2] for b in x))
    pairs = {(r.event_id, r.control_ms) for r in M.near_pairs(ev, br, "x", "z", 1.5, 3.0, 50).collect()}
    assert pairs == {(e[0], b[1]) for e in events for b in bars if all(near(e, b))}


def test_nearest_controls_are_used_once(spark):
    events, bars = sample(3, 60, 90)
    events += [(100 + k, "a", 10 * k, 20.0, 20.0) for k in range(5)]  # ties
    bars += [("a", 2_000 + k, 20.0, 20.0) for k in range(3)]
    got = M.nearest_once(M.near_pairs(*frames(spark, events, bars), "x", "z", 1.5, 3.0, 50)).collect()
    part = lambda a, b, f: abs(math.log(a / b)) / math.log(f)
    pairs = sorted((round(math.hypot(part(e[3], b[2], 1.5), part(e[4], b[3], 3.0)), 12), e[0], e[1], b[1]) for e in events for b in bars if all(near(e, b)))
    used, want = set(), set()
    for _, e, s, t in pairs:
        if e not in used and (s, t) not in used:
            used |= {e, (s, t)}
            want.add((e, s, t))
    assert {(r.event_id, r.symbol, r.control_ms) for r in got} == want and len(got) == len(want)
    assert M.nearest_once(M.near_pairs(*frames(spark, events[:1], bars), "x", "z", 1.0001, 1.0001, 5_000)).count() == 0


def test_draws_of_many_seeds_are_plain_minima(spark):
    rows = [(e, c) for e in range(4) for c in range(0, 7 * e + 1)]
    got = {(r.event_id, r.seed, r.draw): (r.control_ms, r.n_pool) for r in M.draw_many(spark.createDataFrame(rows, "event_id long, control_ms long"), ["event_id"], 5, 3).collect()}
    assert len(got) == 4 * 5 * 3
    for (e, s, d), (c, n) in got.items():
        a, b = M.multiplier(s, d)
        h = lambda x, e=e: int(hashlib.md5(f"{e}-{x}".encode()).hexdigest()[:12], 16) % M.PRIME
        assert (c, n) == (min(range(7 * e + 1), key=lambda x: ((h(x) * a + b) % M.PRIME, x)), 7 * e + 1)
    assert len({c for (e, _, _), (c, _) in got.items() if e == 3}) > 5


def test_draws_shuffle_nothing_where_pairs_lie_by_event(spark):
    rows = [(e, 1, t, float(e * t)) for e in range(6) for t in range(9)]
    pairs = spark.createDataFrame(rows, "event_id long, symbol long, control_ms long, r double").repartition("event_id")
    found = M.draw_pools(pairs, ["event_id", "symbol"], 3, 2, carry=("r",))
    drawn = [(r.event_id, x.control_ms, x.r) for r in found.collect() for x in r.drawn]
    assert len(drawn) == 6 * 3 * 2 and all(r == e * t for e, t, r in drawn)
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hash") == 1


@pytest.mark.parametrize("seed", [3, 4])
def test_nearest_bars_are_paired_anew_and_few_pairs_are_written(spark, monkeypatch, seed):
    events, bars = sample(seed, 40, 300)
    frame = frames(spark, events, bars)
    want = {(r.event_id, r.control_ms, r.round) for r in M.nearest_once(M.near_pairs(*frame, "x", "z", 1.5, 3.0, 50)).collect()}
    written, real = [], M.settled
    monkeypatch.setattr(M, "settled", lambda df: written.append(real(df)) or written[-1])
    got = {(r.event_id, r.control_ms, r.round) for r in M.nearest_bars_once(*frame, "x", "z", 1.5, 3.0, 50).collect()}
    assert got == want and max(k for *_, k in got) > 1
    n_pairs = M.near_pairs(*frame, "x", "z", 1.5, 3.0, 50).count()
    assert max(df.count() for df in written if "distance" in df.columns) < n_pairs / 3
