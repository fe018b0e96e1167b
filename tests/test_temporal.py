"""Time joins over slices against plain loops, one symbol holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import inventory as I
from tidemark.operators import temporal as T


def hot(rng, n):
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([rng.randint(-50, 400), None] + [rng.randint(0, 400)] * 8)) for _ in range(n)]


@pytest.mark.parametrize("slice_ms", [1, 13, 10_000])
def test_window_counts_and_overlaps(spark, slice_ms):
    rng = random.Random(slice_ms)
    events, prints = hot(rng, 60), hot(rng, 200)
    events += events[:7]
    spans = [(k, t, t + rng.randint(-3, 25)) for k, t in hot(rng, 25) if t is not None]
    ev = spark.createDataFrame([(k, t, 1.5) for k, t in events], "symbol string, ts_ms long, __n double").repartition(3)
    pr = spark.createDataFrame(prints, "symbol string, ts_ms long").repartition(3)
    out = T.window_counts(ev, pr, "symbol", "ts_ms", {"before": (-20, 0), "after": (0, 35)}, slice_ms)
    assert out.columns == [*ev.columns, "before", "after"]
    want = [(k, t, *(sum(x is not None and k == y and t is not None and low < x - t <= high for y, x in prints) for low, high in ((-20, 0), (0, 35)))) for k, t in events]
    want = [(k, t, *((0, 0) if k is None else c)) for k, t, *c in want]
    assert sorted(((r.symbol, r.ts_ms, r.before, r.after) for r in out.collect()), key=repr) == sorted(want, key=repr)
    iv = spark.createDataFrame(spans, "symbol string, lo long, hi long")
    met = T.overlaps(ev, iv, "symbol", "ts_ms", 5, "lo", "hi", slice_ms=slice_ms)
    want = [(k, t, k is not None and t is not None and any(x == k and a <= b and a <= t + 5 and b >= t for x, a, b in spans)) for k, t in events]
    assert sorted(((r.symbol, r.ts_ms, r.overlaps) for r in met.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("forward", [False, True])
def test_asof_join_in_slices_equals_one_slice(spark, forward):
    rng = random.Random(5)
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(hot(rng, 80))], "id long, symbol string, ts_ms long")
    right = spark.createDataFrame([(i, *x) for i, x in enumerate(hot(rng, 120))], "seq long, symbol string, ts_ms long")
    runs = [sorted((tuple(r) for r in T.asof_join(left, right, "symbol", "ts_ms", ["seq"], forward=forward, tie="seq", tolerance_ms=30, slice_ms=s).collect()), key=repr) for s in (None, 7, 60, T.SLICE_MS)]
    assert runs[0] == runs[1] == runs[2] == runs[3]


def test_ranking_events_have_every_label(spark):
    """Ranks of four symbols over six snapshots; x comes back, y jumps, z stays to the end, w is there from the start."""
    ranks = {"w": [1, 1, 1, 1, 1, 1], "x": [None, 2, None, 2, 2, 9], "y": [40, 9, 8, None, 3, None], "z": [None, None, None, 4, 4, 4]}
    rows = [("l", 10 * k, s, r) for s, seen in ranks.items() for k, r in enumerate(seen) if r is not None]
    df = spark.createDataFrame(rows, "ranking_type string, snap_ms long, symbol string, rank int")
    cells = I.Cells(tops=(5,), jumps=(10,), jump_from=((31, 50), (11, 30)), stays=(2, 3))
    found = {(r.symbol, r.snap_ms): (sorted(tuple(x) for x in r.labels), r.prev_gap_ms) for r in I.ranking_events(df, cells).collect()}
    assert found == {
        ("x", 10): ([("new_entry", "top5")], 10),
        ("x", 30): ([("dwell_start", "top5_for2"), ("new_entry", "top5")], 10),
        ("y", 10): ([("rank_jump", "by10"), ("rank_jump", "by10_from31_50")], 10),
        ("y", 40): ([("new_entry", "top5")], 10),
        ("z", 30): ([("dwell_start", "top5_for2"), ("dwell_start", "top5_for3"), ("new_entry", "top5")], 10),
    }
    over = {(r.symbol, r.snap_ms): (r.overlapping, r.n_overlapping) for r in I.with_overlapping(I.ranking_events(df, cells), 20).collect()}
    assert over["y", 10] == (["rank_jump"], 0) and over["x", 30] == (["dwell_start", "new_entry"], 1)
