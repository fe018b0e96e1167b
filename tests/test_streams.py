"""Stateful streams against their batch forms, plain loops, and refreshes in mid-stream."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from tidemark.streaming import tiers as Z
from tidemark.streaming.replay import run_to_end, table_stream
from tidemark.streaming.versions import VersionedTable, enriched


def plain_tiers(rows, rules, until):
    """One symbol's changes, minute by minute rather than by timers."""
    tier, changed, below, last, score, out = 1, None, None, None, None, []
    by_time = {}
    for t, s in sorted(rows, key=lambda r: r[0]):
        by_time.setdefault(t, []).append(s)
    for t in range(0, until + 1):
        if tier > 1 and t - last >= rules.stale_ms and (changed is None or t - changed >= rules.hold_ms):
            out.append((t, tier, tier - 1, "stale", score))
            tier, changed = tier - 1, t
        for s in by_time.get(t, ()):
            score, last, free = s, t, changed is None or t - changed >= rules.hold_ms
            want = 1 + sum(s >= b for b in rules.up)
            if want > tier:
                below = None
                if free:
                    out.append((t, tier, tier + 1, "score", s))
                    tier, changed = tier + 1, t
            elif want == tier or s >= rules.down[tier - 2]:
                below = None
            elif below is None:
                below = t
            elif t - below >= rules.hold_ms:
                below = None
                if free:
                    out.append((t, tier, tier - 1, "score_decay", s))
                    tier, changed = tier - 1, t
    return out


def plain_seats(snaps, rules):
    score, changed, seated, out = {}, {}, set(), []
    for t, now in snaps:
        score.update(now)
        free = lambda s, t=t: s not in changed or t - changed[s] >= rules.hold_ms
        able = {s for s in score if free(s)}
        for s in sorted(able & seated):
            if score[s] < rules.floor:
                seated.discard(s)
                able.discard(s)
                changed[s] = t
                out.append((t, s, "left", score[s]))
        for s in sorted(able - seated, key=lambda s: (-score[s], s)):
            if score[s] < rules.floor:
                break
            if len(seated) >= rules.capacity:
                weakest = min(seated, key=lambda x: (score[x], -x))
                if weakest not in able or score[s] <= score[weakest] + rules.margin:
                    break
                seated.discard(weakest)
                able.discard(weakest)
                changed[weakest] = t
                out.append((t, weakest, "evicted", score[weakest]))
            seated.add(s)
            able.discard(s)
            changed[s] = t
            out.append((t, s, "seated", score[s]))
    return out


def write(spark, rows, schema, path, parts=3):
    for k in range(parts):  # the last row comes last: it moves the watermark
        spark.createDataFrame(rows[k:-1:parts] + rows[-1:] * (k + 1 == parts), schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # files are read in the order of their times


def test_tier_stream_equals_batch_and_plain(spark, tmp_path):
    """Rows come out of order within the delay; a symbol that falls silent is taken down by timers."""
    rng, rules = random.Random(3), Z.TierRules(up=(0.3, 0.6), down=(0.22, 0.5), hold_ms=50, stale_ms=200)
    rows = [(s, rng.randint(0, 3_000 if s < 3 else 700), 0, 0.0) for s in range(5) for _ in range(60)] + [(9, 6_000, 0, 0.1)]
    rows = [(s, t, k, round(rng.random(), 3)) for k, (s, t, _, _) in enumerate(rows)]
    rows = list({(s, t): (s, t, k, x) for s, t, k, x in rows}.values())
    schema = "symbol long, ts_ms long, tie long, score double"
    write(spark, rows, schema, tmp_path / "in")
    want = sorted((s, *c) for s in range(5) for c in plain_tiers([(t, x) for y, t, _, x in rows if y == s], rules, 3_000))
    batch = Z.tier_machine(spark.createDataFrame(rows, schema).repartition(3), rules, 3_000)
    assert sorted(map(tuple, batch.collect())) == want
    assert {c[4] for c in want} == {"score", "score_decay", "stale"}
    stream = Z.tier_machine_stream(table_stream(spark, str(tmp_path / "in"), 1), rules, "3 seconds")
    assert sorted(map(tuple, run_to_end(stream).collect())) == want


def test_pool_stream_equals_batch_and_plain(spark, tmp_path):
    rng, rules = random.Random(8), Z.PoolRules(capacity=3, floor=0.3, margin=0.08, hold_ms=25)
    rows = [(p, 10 * t, s, round(rng.random(), 2)) for p in (0, 1) for t in range(1, 31) for s in range(p, 16, 2) if rng.random() < 0.8] + [(7, 900, 99, 0.0)]
    schema = "pool long, ts_ms long, symbol long, score double"
    write(spark, rows, schema, tmp_path / "in")
    want = []
    for p in (0, 1):
        snaps = [(t, {s: x for q, u, s, x in rows if (q, u) == (p, t)}) for t in range(10, 310, 10)]
        want += [(p, *c) for c in plain_seats(snaps, rules)]
    batch = Z.pool_seats(spark.createDataFrame(rows, schema), rules, 600)
    assert sorted(map(tuple, batch.collect())) == sorted(want)
    assert {c[3] for c in want} == {"seated", "left", "evicted"}
    stream = Z.pool_seats_stream(table_stream(spark, str(tmp_path / "in"), 1), rules, "300 milliseconds")
    assert sorted(map(tuple, run_to_end(stream).collect())) == sorted(want)


def test_a_refresh_changes_only_later_batches(spark, tmp_path):
    rows = [(k % 4, k) for k in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "symbol long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    table = VersionedTable(spark, f"file://{tmp_path}/lookup", "symbol long, v long")
    table.publish(spark.createDataFrame([(s, 100) for s in range(3)], "symbol long, v long"))
    join, out = enriched(table, "symbol", lambda e: f"file://{tmp_path}/out/epoch={e}"), []

    def each(batch, epoch):
        join(batch, epoch)
        if epoch == 1:
            table.publish(spark.createDataFrame([(s, 200) for s in range(4)], "symbol long, v long"))
            join(batch, epoch)  # an epoch that is run again sees what it saw

    run_to_end(table_stream(spark, str(tmp_path / "in"), 1), each)
    out = {(r.symbol, r.n): r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {(s, n): 200 if n >= 20 else 100 if s < 3 else None for s, n in rows}
    table.retire(2)
    assert table.current() == 2 and table.read().count() == 4


def test_history_is_made_for_new_keys_once(spark, tmp_path):
    for part in ([(1, 1), (2, 2)], [(1, 3), (2, 4)], [(3, 5), (1, 6), (None, 7)]):
        spark.createDataFrame(part, "symbol long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    asked, table = [], VersionedTable(spark, f"file://{tmp_path}/lookup", "symbol long, v long")

    def history(symbols):
        asked.append(sorted(r.symbol for r in symbols.collect()))
        return symbols.withColumn("v", F.col("symbol") * 10)

    run_to_end(table_stream(spark, str(tmp_path / "in"), 1), enriched(table, "symbol", lambda e: f"file://{tmp_path}/out/epoch={e}", history))
    assert asked == [[1, 2], [3]]
    assert {(r.n, r.v, r.version) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 10, 1), (2, 20, 1), (3, 10, 1), (4, 20, 1), (5, 30, 2), (6, 10, 2), (7, None, 2)}


def test_baselines_of_no_volume_divide_as_in_sql(spark, tmp_path):
    import math

    from tidemark.plans.streams import lazy_baselines

    day = "2024-01-%02d 05:00:00"
    rows = [(1, day % 1, 7, 0), (2, day % 2, 8, 4), (3, day % 15, 7, 5), (4, day % 15, 7, 0), (5, day % 15, 8, 6), (6, day % 16, 9, 6)]
    events = spark.createDataFrame([(e, t, u, "purchase", 1.0, f'{{"k": {k}}}') for e, t, u, k in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.day_ratio for r in lazy_baselines(spark, str(tmp_path)).collect()}
    assert got[3] == math.inf and math.isnan(got[4]) and got[5] == 1.5 and got[6] is None and len(got) == 4


def test_a_group_of_symbols_asks_for_its_state_once():
    asked = []

    class States:
        def __init__(self):
            self.rows = []

        def get(self):
            asked.append(len(self.rows))
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def appendList(self, rows):  # noqa: N802
            self.rows += rows

    class Handle:
        now, timers = 0, []

        def getListState(self, name, schema):  # noqa: N802
            return States()

        def getValueState(self, name, schema):  # noqa: N802
            raise AssertionError("a state for each symbol")

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    rules = Z.TierRules(hold_ms=10, stale_ms=50)
    rows = [(s, t, t, score) for s in range(40) for t, score in ((5, 0.4), (20 + s, 0.7), (60 + s, 0.1))]
    want = set()
    for s in range(40):
        state = Z.TierState(rules)
        want |= {(s, *c) for _, t, _, score in (r for r in rows if r[0] == s) for c in state.hear(t, score)} | {(s, *c) for c in state.advance(500)}
    handle, machine = Handle(), Z._TierProcessor(rules)
    machine.init(handle)
    list(machine.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["symbol", "ts_ms", "tie", "score"])]), handle))
    handle.now = 500
    got = [tuple(x) for pdf in machine.handleExpiredTimer((0,), handle, None) for x in pdf.itertuples(index=False)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    assert len(asked) == 2  # the rows that wait, and the tiers
