import time

from pyspark.sql import functions as F

from tidemark.functions import sessions as S
from tidemark.operators import events, execution, resampling, stats, temporal
from tidemark.sources import store
from tidemark.streaming import market


def test_sessions_begin_inside_and_end_outside(spark):
    # KST minutes, as UTC milliseconds of one day
    minute = lambda m: ((m - 540) % 1440) * 60_000
    cases = {540: "day", 1019: "day", 1020: "pre", 1349: "pre", 1350: "regular", 0: "regular", 299: "regular", 300: "after", 529: "after", 530: "closed", 539: "closed"}
    df = spark.createDataFrame([(m, minute(m)) for m in cases], "m int, ts long")
    assert {r.m: r.s for r in df.select("m", S.session_of(F.col("ts")).alias("s")).collect()} == cases


def test_asof_ties_tolerance_and_nulls(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (1, 100, "c"), (2, 10, "d"), (None, 10, "e")], "k int, t long, name string")
    right = spark.createDataFrame([(1, 5, 1, 50), (1, 10, 1, 100), (1, 10, 2, 101), (1, 20, 1, 200)], "k int, t long, seq int, v int")
    got = lambda **o: {r.name: r.v for r in temporal.asof_join(left, right, "k", "t", ["v"], tie="seq", **o).collect()}
    assert got() == {"a": 101, "b": 50, "c": 200, "d": None, "e": None}
    assert got(strict=True) == {"a": 50, "b": None, "c": 200, "d": None, "e": None}
    assert got(tolerance_ms=50) == {"a": 101, "b": 50, "c": None, "d": None, "e": None}
    assert got(forward=True) == {"a": 100, "b": 50, "c": None, "d": None, "e": None}
    assert got(forward=True, strict=True) == {"a": 200, "b": 100, "c": None, "d": None, "e": None}
    for width in (1, 7, 15, 1000):  # slices of time change nothing
        for options in ({}, {"strict": True}, {"tolerance_ms": 50}, {"forward": True}, {"forward": True, "strict": True}):
            assert got(slice_ms=width, **options) == got(**options)


def test_range_pairs_match_all_pairs(spark):
    left = [(k, t) for k in (1, 2) for t in range(0, 100, 7)]
    right = [(k, t) for k in (1, 3) for t in range(-20, 120, 3)]
    got = temporal.range_pairs(spark.createDataFrame(left, "k int, t long"), spark.createDataFrame(right, "k int, t long"), "k", "t", -5, 11).collect()
    want = sorted((k, t, u) for k, t in left for j, u in right if j == k and -5 < u - t <= 11)
    assert sorted((r.k, r.t, r.r_t) for r in got) == want


def test_book_walk_skips_dust_and_tells_exhaustion(spark):
    book = '{"bids": [{"price_u": 9900000, "qty_u": 2000000}, {"price_u": 0, "qty_u": 5}], "asks": [{"price_u": 10100000, "qty_u": 1000000}, {"price_u": 10000000, "qty_u": 1}, {"price_u": 10200000, "qty_u": 9000000}]}'
    df = spark.createDataFrame([(book,), ("not json",), (None,)], "j string").select(execution.parse_depth(F.col("j")).alias("d"))
    w = df.select(execution.walk_book(F.col("d.asks"), 20.0).alias("w")).collect()
    assert (w[0].w.spent_u, w[0].w.exhausted, w[0].w.levels_used) == (20_000_000, False, 3)
    assert w[1].w.exhausted and w[1].w.avg_px_u is None and w[2].w.levels_used == 0


def test_causal_fires_match_a_plain_scan(spark):
    import random

    rng = random.Random(4)
    data = [(s, t * 10, rng.randint(80, 140)) for s in (1, 2) for t in range(200)]
    got = sorted((r.symbol, r.ts_ms) for r in events.causal_fires(spark.createDataFrame(data, "symbol long, ts_ms long, price_u long"), 0.4, 100, 150).collect())
    want = []
    for s in (1, 2):
        series, before, last = [(t, p) for k, t, p in data if k == s], False, None
        for i, (t, p) in enumerate(series):
            above = p >= min(q for u, q in series[: i + 1] if t - u <= 100) * 1.4
            if above and not before and (last is None or t - last >= 150):
                want.append((s, t))
                last = t
            before = above
    assert got == want


def test_causal_fires_stream_their_stretches(spark):
    """Stretches that batches cut and keys that doubles can't hold; no call for each stretch."""
    big = 2**60 + 1
    data = [(s, t * 10, 100 + 100 * (t % 2)) for s in (big, big + 1) for t in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = events.causal_fires(spark.createDataFrame(data, "symbol long, ts_ms long, price_u long"), 0.4, 1_000, 50)
        assert sorted((r.symbol, r.ts_ms) for r in found.collect()) == [(s, t) for s in (big, big + 1) for t in range(10, 400, 60)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_impulses_do_not_overlap(spark):
    data = [(1, t * 1000, p) for t, p in enumerate([100, 100, 103, 104, 104, 103, 100, 90, 93, 95, 94])]
    got = events.impulses(spark.createDataFrame(data, "symbol long, ts_ms long, price_u long"), 0.02, 60_000, 60_000).orderBy("start_ms").collect()
    assert [(r.ordinal, r.start_ms, r.detect_ms, r.peak_ms) for r in got] == [(1, 0, 2000, 4000), (2, 7000, 8000, 9000)]


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(2000).select((F.col("id") % 100).alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("v"))
    r = resampling.bootstrap_mean(df, [], "g", "v", 400, 3).first()
    assert r.ci_low < r["mean"] < r.ci_high and r.n_clusters == 100


def test_store_upserts_archives_and_flags(spark, tmp_path):
    current = spark.createDataFrame([(1, 10, 5), (2, 10, 6)], "symbol int, ts_ms long, v int")
    changes = spark.createDataFrame([(2, 20, 7), (2, 30, 8), (3, 5, 9)], "symbol int, ts_ms long, v int")
    got = store.upsert(current, changes, ["symbol"], ["ts_ms"])
    assert sorted(map(tuple, got.collect())) == [(1, 10, 5), (2, 30, 8), (3, 5, 9)]
    assert store.insert_ignore(current, changes, ["symbol"]).select("symbol").collect() == [(3,)]
    left = store.archive(got, str(tmp_path / "a"), "ts_ms", 20, ["symbol"])
    assert [r.symbol for r in left.collect()] == [2]
    assert sorted(r.symbol for r in spark.read.parquet(str(tmp_path / "a")).collect()) == [1, 3]
    assert {r.symbol: r.hot for r in store.replace_flags(current, "symbol", changes, "hot").collect()} == {1: False, 2: True}
    (tmp_path / "d.txt").write_text("Symbol|Security Name|Test Issue|ETF\nAAA|A|N|N\nBBB|B|Y|N\nCCC|C|N|Y\nFile Creation Time|x||\n")
    assert [r.symbol for r in store.directory(spark, str(tmp_path / "d.txt")).collect()] == ["AAA"]
    (tmp_path / "log.txt").write_text("2024-01-01 00:00:01 gap symbol=A n=3\nnoise\n")
    r = store.log_events(spark, str(tmp_path / "log.txt")).first()
    assert (r.event, r.fields) == ("gap", {"symbol": "A", "n": "3"})


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    return q


def test_streams_match_batches(spark, tmp_path):
    day = 86_400_000
    rows = [(s, day + t, p, q) for s, t, p, q in [(1, 0, 10, 1), (1, 1_000, 12, 1), (1, 1_000, 12, 1), (1, 70_000, 11, 2), (2, 5_000, 7, 1), (1, 900_000, 13, 1)]]
    schema = "symbol long, ts_ms long, price_u long, qty_u long"
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(market.deduplicated(stream(), ["symbol", "ts_ms", "price_u", "qty_u"]), "dedup")
    assert spark.table("dedup").count() == 5
    run(market.tape_gaps(stream(), 60_000), "gaps")
    assert sorted(map(tuple, spark.table("gaps").collect())) == [(1, day + 1_000, day + 70_000), (1, day + 70_000, day + 900_000)]
    run(market.streamed_bars(stream(), "1 minute", ["price_u"], "1 minute"), "bars")
    got = {(r.symbol, r.ts_ms - day): (r.open_u, r.close_u, r.n) for r in spark.table("bars").collect()}
    assert got[1, 60_000] == (10, 12, 3) and got[2, 60_000] == (7, 7, 1)


def test_tiers_rise_at_once_and_fall_after_the_dwell(spark, tmp_path):
    rows = [(1, 0, 0.7), (1, 100, 0.1), (1, 700_000, 0.1), (1, 700_100, 0.1), (1, 1_400_000, 0.1)]
    spark.createDataFrame(rows, "symbol long, ts_ms long, score double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol long, ts_ms long, score double").parquet(str(tmp_path / "in"))
    run(market.tier_changes(stream), "tiers")
    assert sorted(map(tuple, spark.table("tiers").collect())) == [(1, 0, 1, 3), (1, 700_000, 3, 2), (1, 1_400_000, 2, 1)]


def test_quadratic_fit_recovers_its_derivatives(spark):
    from tidemark.operators.baselines import quadratic_derivatives

    df = spark.createDataFrame([(1, t, 5 + 3 * t + 2 * t * t) for t in range(8)], "symbol int, day int, close_u long")
    last = quadratic_derivatives(df, 4).where("day = 7").first()
    assert abs(last.velocity - (3 + 4 * 7)) < 1e-6 and abs(last.acceleration - 4) < 1e-6


def test_signal_exits_match_a_plain_scan(spark):
    import random

    from tidemark.operators import exits

    rng = random.Random(5)
    prices = [(s, t * 10 + 5, k, 100 + rng.randint(-9, 9)) for s in (1, 2) for k, t in enumerate(range(0, 60, 2))]
    signal = [(s, t * 10, rng.randint(1, 9)) for s in (1, 2) for t in range(60)]
    entries = [(i, 1 + i % 2, rng.randint(0, 620)) for i in range(40)]
    rules = {"stall": ("stall", 40), "worsen": ("worsen", 5), "drop": ("drop", 0.3), "rise": ("rise", 2.0)}
    table = spark.createDataFrame([(r, *x) for r in rules for x in signal], "rule string, symbol int, ts_ms long, value int")
    got = exits.signal_exits(spark.createDataFrame(prices, "symbol int, ts_ms long, event_id int, price_u long"), table, spark.createDataFrame(entries, "entry_id int, symbol int, entry_ms long"), rules, horizon_ms=100)
    for r in got.collect():
        _, symbol, start = entries[r.entry_id]
        seen = [(t, v) for s, t, v in signal if s == symbol and start <= t <= start + 100]
        at = lambda t: max(((u, p) for s, u, _, p in prices if s == symbol and u <= t), default=(None, None))  # noqa: B023, E731
        kind, bound = rules[r.rule]
        hit = None
        for i, (t, v) in enumerate(seen):
            before = seen[:i]
            if hit or not before or at(t)[1] is None:
                continue
            low, since = min((w, u) for u, w in before)
            fired = {"stall": v >= low and t - since >= bound, "worsen": v >= low + bound, "drop": v <= bound * max(w for _, w in before), "rise": v >= bound * seen[0][1]}[kind]
            hit = (t, at(t)[1]) if fired else None
        last = at(start + 100)
        end = hit or (last if last[0] is not None and last[0] >= start else None)
        want = (end[1], end[0], hit is not None, True) if len(seen) >= 3 and end else (None, None, False, False)
        assert (r.exit_u, r.exit_ms, r.filled, r.available) == want, r


def test_zero_prices_give_null_returns(spark):
    """Prices that round to zero divide nothing: returns are null, and no query fails."""
    from tidemark.operators.bars import flow_windows, log_return, ratio, tick_rule
    from tidemark.operators.baselines import realized_vol, split_dates
    from tidemark.operators.events import daily_events
    from tidemark.operators.execution import align_trades

    day = 86_400_000
    ticks = spark.createDataFrame([("a", k, k * day // 2, p, 1) for k, p in enumerate((0, 5, 7, 0, 8, 9))], "symbol string, event_id long, ts_ms long, price_u long, qty_u long")
    got = {r["start_ms"]: r["ret_bp"] for r in flow_windows(tick_rule(ticks, ["event_id"]), day, ["event_id"]).collect()}
    assert got[0] is None and got[day] is None and abs(got[2 * day] - 1e4 * 0.11778303565638346) < 1e-6
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("a"), log_return(F.lit(3), F.lit(0)).alias("b")).first() == (None, None)
    bars = spark.createDataFrame([("a", d, p, p, p, p, 1) for d, p in enumerate((0, 5, 0, 9))], "symbol string, day int, open_u long, high_u long, low_u long, close_u long, vol long")
    assert realized_vol(bars, 3).where("realized_vol is not null").count() == 0
    assert [r["day"] for r in split_dates(bars, 3.0).collect()] == [2]
    assert daily_events(bars, 0.5, 2).count() == 0
    quotes = ticks.select("symbol", "event_id", "ts_ms", F.lit(0).cast("long").alias("mid_u"))
    assert align_trades(ticks, quotes, day, 1).where("markout_bp is not null").count() == 0


def test_daily_bars_shuffle_items_before_they_are_aggregated(spark):
    from tidemark.sources import views as V

    plan = V.candles_1d(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan.split("Exchange")[0] and "Aggregate" not in plan.split("Exchange")[1]
