"""Rule grids against a plain walk along each path."""

import random

from tidemark.operators import rules as G

W = G.When
RULES = (G.Rule("a", (W("take", 0.2), W("stop", 0.1))), G.Rule("b", (W("trail", 0.15), W("rank_worse", 3))), G.Rule("c", (W("held", 40),)), G.Rule("d", (W("share_drop", 0.5), W("quiet", 1))), G.Rule("e", (W("take", 5.0),)))


def holds(c, e, bar, peak):
    t, high, low, close, n, rank, share = bar
    _, _, t0, entry, rank0, share0 = e
    return {
        "stop": lambda b: low <= entry * (1 - b),
        "take": lambda b: high >= entry * (1 + b),
        "trail": lambda b: close <= peak * (1 - b),
        "held": lambda b: t - t0 >= b,
        "rank_worse": lambda b: rank is not None and rank0 is not None and rank - rank0 >= b,
        "share_drop": lambda b: share is not None and share0 is not None and share <= share0 * (1 - b),
        "quiet": lambda b: n <= b,
    }[c.kind](c.bound)


def test_every_rule_leaves_where_a_walk_leaves(spark):
    rng = random.Random(6)
    path, entries = [], []
    for s in ("x", "y"):
        for t in range(0, 400, 10):
            close = rng.randint(80, 125)
            path.append((s, t, close + rng.randint(0, 12), close - rng.randint(0, 12), close, rng.randint(1, 9), rng.choice([None, rng.randint(1, 9)]), rng.choice([None, rng.random()])))
    for k in range(30):
        entries.append((k, rng.choice("xyz"), rng.randint(-20, 390), rng.randint(90, 115), rng.choice([None, 4]), rng.choice([None, 0.6])))
    schema = "symbol string, ts_ms long, high_u long, low_u long, close_u long, n long, rank int, share double"
    e = spark.createDataFrame(entries, "entry_id long, symbol string, ts_ms long, entry_u long, entry_rank int, entry_share double")
    got = {(r.entry_id, r.rule): (r.exit_ms, r.reason, None if r.ret is None else round(r.ret, 9)) for r in G.evaluate_rules(e, spark.createDataFrame(path, schema), RULES, 90).collect()}
    want = {}
    for x in entries:
        bars = sorted(b[1:] for b in path if b[0] == x[1] and x[2] < b[1] <= x[2] + 90)
        for rule in RULES:
            want[x[0], rule.name], peak = (None, None, None), x[3]
            for b in bars:
                peak = max(peak, b[1])
                met = sorted((c for c in rule.any_of if holds(c, x, b, peak)), key=lambda c: G.ORDER.index(c.kind))
                last = b is bars[-1]
                if met or last:
                    kind = met[0].kind if met else "horizon"
                    ret = -met[0].bound if kind == "stop" else met[0].bound if kind == "take" else b[3] / x[3] - 1
                    want[x[0], rule.name] = (b[0], kind, round(ret, 9))
                    break
    assert got == want and len({r for _, r, _ in got.values()}) >= 7


def test_ranking_shares_places_and_needs_support(spark):
    rows = [("a", 50, 0.1), ("b", 50, 0.2), ("c", 50, 0.1), ("d", 9, 0.9), ("e", 50, None)]
    out = G.ranked_rules(spark.createDataFrame(rows, "rule string, n long, ci_low double"), 30)
    assert {r.rule: r.place for r in out.collect()} == {"a": 2, "b": 1, "c": 2, "d": None, "e": None}
