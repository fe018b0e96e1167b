"""Registered queries of events within days, rising runs and exits on them; they join those of tidemark.plans.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import baselines as L
from tidemark.operators import intraday as I
from tidemark.operators.bars import ratio
from tidemark.operators.temporal import asof_join
from tidemark.plans.exits import entries
from tidemark.plans.queries import CURVE, DAY, HOUR, NUDGE, RANKS, TICKS, doubles, placed, query, rounded
from tidemark.sources import views as V

INTRADAY = (
    CURVE
    + f""", vols AS (SELECT p.*, sum(p.vol_qu) OVER (PARTITION BY p.symbol, p.session, p.date ORDER BY p.ts_ms ROWS UNBOUNDED PRECEDING) / CASE WHEN c.mean_cum > 0 THEN c.mean_cum END AS rvol
 FROM placed p LEFT JOIN curve c USING (symbol, session, minute)),
 ib AS (SELECT symbol, ts_ms, open_u, high_u, low_u, close_u, date AS day, rvol, minute BETWEEN 14 AND 19 AS regular FROM vols),
 id AS (SELECT symbol, day, coalesce(arg_max(close_u, ts_ms) FILTER (regular), arg_max(close_u, ts_ms)) AS c, arg_min(open_u, ts_ms) AS o FROM ib GROUP BY ALL),
 ic AS (SELECT symbol, day, lag(c) OVER w AS prev_close_u, lead(o) OVER w AS next_open_u FROM id WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 im AS (SELECT *, min(close_u) OVER (PARTITION BY symbol, day ORDER BY ts_ms RANGE BETWEEN {8 * HOUR} PRECEDING AND CURRENT ROW) AS low_c FROM ib JOIN ic USING (symbol, day)),
 ih AS (SELECT *, coalesce(low_c > 0 AND close_u >= low_c * 1.3, false) AS win, coalesce(prev_close_u > 0 AND close_u >= prev_close_u * 2.0, false) AS by_day FROM im),
 it AS (SELECT *, min(ts_ms) FILTER ((win OR by_day) AND coalesce(rvol >= 0.5, true)) OVER (PARTITION BY symbol, day) AS t0_ms, lag(ts_ms) OVER (PARTITION BY symbol, day ORDER BY ts_ms) AS p_ms FROM ih),
 ik AS (SELECT symbol, day, t0_ms, max(high_u) AS peak_u, arg_min(ts_ms, -high_u * 10000000000000::HUGEINT + ts_ms) AS peak_ms FROM it WHERE ts_ms >= t0_ms GROUP BY ALL),
 il AS (SELECT symbol, day, t0_ms, any_value(prev_close_u) AS prev_close_u, any_value(next_open_u) AS next_open_u, peak_u, peak_ms, bool_or(win) FILTER (ts_ms = t0_ms) AS win, bool_or(by_day) FILTER (ts_ms = t0_ms) AS by_day,
 max(open_u) FILTER (ts_ms = t0_ms) AS t0_open_u, max(close_u) FILTER (ts_ms = t0_ms) AS t0_close_u, max(high_u) AS hod_u, arg_max(close_u, ts_ms) AS last_u,
 min(low_u) FILTER (ts_ms >= peak_ms AND ts_ms <= peak_ms + {6 * HOUR}) AS fall_u, count(*) FILTER (p_ms >= t0_ms AND ts_ms - p_ms >= {3 * HOUR}) AS n_gaps,
 count(*) FILTER (ts_ms >= t0_ms - {12 * HOUR} AND ts_ms < t0_ms - {HOUR}) AS n_pre, arg_min(close_u, ts_ms) FILTER (ts_ms >= t0_ms - {12 * HOUR} AND ts_ms < t0_ms - {HOUR}) AS pre_first_u,
 arg_max(close_u, ts_ms) FILTER (ts_ms >= t0_ms - {12 * HOUR} AND ts_ms < t0_ms - {HOUR}) AS pre_last_u, max(high_u) FILTER (ts_ms >= t0_ms - {12 * HOUR} AND ts_ms < t0_ms - {HOUR}) AS pre_high_u,
 min(low_u) FILTER (ts_ms >= t0_ms - {12 * HOUR} AND ts_ms < t0_ms - {HOUR}) AS pre_low_u FROM it JOIN ik USING (symbol, day, t0_ms) GROUP BY symbol, day, t0_ms, peak_u, peak_ms),
 ie AS (SELECT *, CASE WHEN win AND by_day THEN 'both' WHEN win THEN 'win' ELSE 'day' END AS kind, peak_u / nullif(t0_close_u, 0)::DOUBLE - 1 AS peak_ret, last_u / nullif(t0_close_u, 0)::DOUBLE - 1 AS ret_close,
 (peak_u - last_u) / nullif(greatest(peak_u - t0_close_u, 0), 0)::DOUBLE AS retrace, peak_ms - t0_ms AS to_peak_ms, next_open_u / nullif(last_u, 0)::DOUBLE - 1 AS next_gap,
 CASE WHEN t0_close_u / nullif(t0_open_u, 0)::DOUBLE - 1 >= 0.5 * 0.3 THEN 'instant' WHEN n_pre < 2 THEN 'mixed' WHEN pre_last_u / nullif(pre_first_u, 0)::DOUBLE - 1 >= 0.05 THEN 'ramp'
 WHEN (pre_high_u - pre_low_u) / nullif(pre_last_u, 0)::DOUBLE <= 0.1 THEN 'coil' ELSE 'mixed' END AS shape FROM il),
 iv AS (SELECT *, CASE WHEN fall_u / nullif(peak_u, 0)::DOUBLE - 1 <= -0.2 THEN 'dump' WHEN peak_ret > 0 AND ret_close < 0.5 * peak_ret THEN 'fade' ELSE 'hold' END AS outcome FROM ie)"""
)


def events(spark, sf_dir):
    bars = placed(spark, sf_dir)
    seen = L.relative_volume(bars, L.volume_curve(bars, "session", "minute", "date", 3), "session", "minute", "date").withColumnRenamed("date", "day")
    return I.detect_events(
        seen.select("symbol", "day", "ts_ms", "open_u", "high_u", "low_u", "close_u", "rvol", "minute"), F.col("minute").between(14, 19),
        rise=0.3, day_rise=1.0, look_ms=8 * HOUR, dump_ms=6 * HOUR, gap_ms=3 * HOUR, pre=(12 * HOUR, HOUR), rvol_min=0.5, least_pre=2,
    )


SHOWN = ("peak_ret", "ret_close", "retrace", "next_gap")


@query(
    f"""WITH {INTRADAY} SELECT symbol, day, t0_ms, kind, shape, outcome, CAST(prev_close_u AS DOUBLE) AS prev_close_u, peak_u, hod_u, to_peak_ms, n_gaps, n_pre,
 {", ".join(f"round({c}, 6) AS {c}" for c in SHOWN)} FROM iv"""
)
def intraday_events(spark, sf_dir):
    """EVT-01..04, WIN-12, 13: the first event of each symbol's day by rise from the trailing low or the close before, gated by
    relative volume, with its labels, shape and outcome."""
    out = doubles(events(spark, sf_dir), "prev_close_u").select("symbol", "day", "t0_ms", "kind", "shape", "outcome", "prev_close_u", "peak_u", "hod_u", "to_peak_ms", "n_gaps", "n_pre", *SHOWN)
    return rounded(out, *SHOWN)


@query(
    f"""WITH {INTRADAY} SELECT shape, outcome, count(*) AS n, round(quantile_cont(peak_ret, 0.5), 6) AS median_peak, round(avg(CASE WHEN ret_close > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_up FROM iv GROUP BY ALL"""
)
def event_shapes(spark, sf_dir):
    """EVT-03, FEAT-15: outcomes by the shape of the rise."""
    out = events(spark, sf_dir).groupBy("shape", "outcome").agg(F.count("*").alias("n"), F.percentile("peak_ret", 0.5).alias("median_peak"), F.avg((F.col("ret_close") > 0).cast("double")).alias("share_up"))
    return rounded(out, "median_peak", "share_up")


BUCKETS = (("early", 0, 6), ("morning", 6, 12), ("noon", 12, 15), ("late", 15, 24))


def _bucket_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {a} AND {x} < {b} THEN '{n}'" for n, a, b in BUCKETS) + " END"


@query(
    f"""WITH {INTRADAY}, m AS (SELECT ret_close, (t0_ms - {HOUR}) % {DAY} // {HOUR} AS h FROM iv), b AS (SELECT *, {_bucket_sql("h")} AS b, {_bucket_sql("h - 1")} AS lo, {_bucket_sql("h + 1")} AS hi FROM m)
 SELECT v.bucket, count(*) FILTER (b = v.bucket) AS n, count(*) FILTER (lo = v.bucket) AS n_minus, count(*) FILTER (hi = v.bucket) AS n_plus,
 count(*) FILTER (b = v.bucket AND (lo IS DISTINCT FROM b OR hi IS DISTINCT FROM b)) AS n_sensitive, round(avg(ret_close) FILTER (b = v.bucket), 6) AS mean_close
 FROM b, (VALUES ('early'), ('morning'), ('noon'), ('late')) v(bucket) GROUP BY v.bucket"""
)
def time_of_day(spark, sf_dir):
    """FEAT-14, FLT-20: events by time of day, and how many a step to either side would move to another bucket."""

    def bucket(x):
        out = None
        for name, a, b in BUCKETS:
            out = F.when((x >= a) & (x < b), name) if out is None else out.when((x >= a) & (x < b), name)
        return out

    h = F.floor((F.col("t0_ms") - HOUR) % DAY / HOUR)
    ev = events(spark, sf_dir).select("ret_close", bucket(h).alias("b"), bucket(h - 1).alias("lo"), bucket(h + 1).alias("hi"))
    every = ev.withColumn("bucket", F.explode(F.array(*[F.lit(n) for n, _, _ in BUCKETS])))
    own = F.col("b").eqNullSafe(F.col("bucket"))
    moved = ~F.col("lo").eqNullSafe(F.col("b")) | ~F.col("hi").eqNullSafe(F.col("b"))
    out = every.groupBy("bucket").agg(
        F.count_if(own).alias("n"), F.count_if(F.col("lo").eqNullSafe(F.col("bucket"))).alias("n_minus"), F.count_if(F.col("hi").eqNullSafe(F.col("bucket"))).alias("n_plus"),
        F.count_if(own & moved).alias("n_sensitive"), F.avg(F.when(own, F.col("ret_close"))).alias("mean_close"),
    )
    return rounded(out, "mean_close")


@query(
    f"""WITH {INTRADAY}, p AS (SELECT symbol, day, lag(day) OVER w AS last_day, count(*) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior FROM iv WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 d AS (SELECT p.symbol, p.day, count(DISTINCT i.day) AS n_days FROM p LEFT JOIN ib i ON i.symbol = p.symbol AND i.day < p.day GROUP BY ALL)
 SELECT p.symbol, p.day, d.n_days AS n_days_before, p.prior AS prior_events_20d, CAST(p.day - p.last_day AS DOUBLE) AS days_since_event, p.last_day IS NOT NULL AS former_runner FROM p JOIN d USING (symbol, day)"""
)
def history_features(spark, sf_dir):
    """FEAT-07: what a symbol's past says about an event: days traded, earlier events, days since the last one."""
    w = Window.partitionBy("symbol").orderBy("day")
    days = placed(spark, sf_dir).select("symbol", F.col("date").alias("day")).distinct().withColumn("n_days_before", F.row_number().over(w).cast("long") - 1)
    ev = events(spark, sf_dir).withColumns({"prior_events_20d": F.count("*").over(w.rangeBetween(-20, -1)), "__last": F.lag("day").over(w)})
    out = ev.join(days, ["symbol", "day"]).withColumn("days_since_event", (F.col("day") - F.col("__last")).cast("double")).withColumn("former_runner", F.col("__last").isNotNull())
    return out.select("symbol", "day", "n_days_before", "prior_events_20d", "days_since_event", "former_runner")


REASONS = ("ok", "price_low", "price_high", "no_previous_close", "no_volume", "first_day")


@query(
    f"""WITH {INTRADAY}, r AS (SELECT CASE WHEN prev_close_u IS NULL THEN 'no_previous_close' WHEN t0_close_u < 20000000 THEN 'price_low' WHEN t0_close_u > 200000000 THEN 'price_high' ELSE 'ok' END AS reason FROM iv)
 SELECT v.reason, count(r.reason) AS n FROM (VALUES {", ".join(f"('{x}')" for x in REASONS)}) v(reason) LEFT JOIN r USING (reason) GROUP BY v.reason"""
)
def sample_filter(spark, sf_dir):
    """FLT-19: why events are left out, the first reason that holds; reasons that never hold are shown as zero."""
    reason = F.when(F.col("prev_close_u").isNull(), "no_previous_close").when(F.col("t0_close_u") < 20_000_000, "price_low").when(F.col("t0_close_u") > 200_000_000, "price_high").otherwise("ok")
    counts = events(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, REASONS))).alias("reason"))
    return every.join(counts, "reason", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    f"""WITH {INTRADAY}, s AS (SELECT iv.*, sha1(concat_ws('|', symbol, day, kind, shape, outcome)) AS h FROM iv) SELECT symbol, day, h AS label_hash, coalesce(h <> lag(h) OVER w, true) AS changed FROM s WINDOW w AS (PARTITION BY symbol ORDER BY day)"""
)
def label_hashes(spark, sf_dir):
    """EVT-23: a hash of each event's labels, and whether it differs from the symbol's last one."""
    told = events(spark, sf_dir).withColumn("label_hash", F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in ("symbol", "day", "kind", "shape", "outcome")])))
    before = F.lag("label_hash").over(Window.partitionBy("symbol").orderBy("day"))
    return told.select("symbol", "day", "label_hash", F.coalesce(F.col("label_hash") != before, F.lit(True)).alias("changed"))


RUNS = (
    TICKS
    + """, rf AS (SELECT *, CASE WHEN price_u < lag(price_u) OVER (PARTITION BY symbol ORDER BY ts_ms, event_id) THEN 1 ELSE 0 END AS f FROM ticks),
 rg AS (SELECT *, sum(f) OVER (PARTITION BY symbol ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM rf),
 rr AS (SELECT symbol, min(ts_ms) AS start_ms, max(ts_ms) AS peak_ms, first(price_u ORDER BY ts_ms, event_id) AS start_u, last(price_u ORDER BY ts_ms, event_id) AS peak_u FROM rg GROUP BY symbol, run),
 runs AS (SELECT *, peak_u / nullif(start_u, 0)::DOUBLE - 1 AS rise, row_number() OVER (PARTITION BY symbol ORDER BY start_ms, peak_ms, start_u) AS ordinal FROM rr WHERE peak_u / nullif(start_u, 0)::DOUBLE - 1 >= 0.5)"""
)


def runs(spark, sf_dir):
    return I.rising_runs(V.ticks(spark, sf_dir), 0.5, ["event_id"])


@query(f"WITH {RUNS} SELECT symbol, CAST(ordinal AS INTEGER) AS ordinal, start_ms, peak_ms, start_u, peak_u, round(rise * {NUDGE}, 6) AS rise FROM runs")
def rising_runs(spark, sf_dir):
    """EVT-13, 15: runs of prices that don't fall and rise by half or more."""
    return rounded(runs(spark, sf_dir), "rise", nudge=True).select("symbol", "ordinal", "start_ms", "peak_ms", "start_u", "peak_u", "rise")


@query(
    f"""WITH {RUNS} SELECT symbol, count(*) AS n_runs, round(log10(exp(sum(ln(1 + rise)))), 4) AS log_total_rise, round(quantile_cont(rise, 0.5), 6) AS median_rise,
 round(quantile_cont(CAST(peak_ms - start_ms AS DOUBLE), 0.5), 1) AS median_span_ms, round(arg_max(rise, ordinal), 6) AS last_rise FROM runs GROUP BY symbol"""
)
def run_summary(spark, sf_dir):
    """EVT-14: a symbol's runs put together: their compounded rise and medians."""
    out = runs(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("n_runs"), F.round(F.log10(F.exp(F.sum(F.log1p("rise")))), 4).alias("log_total_rise"), F.percentile("rise", 0.5).alias("median_rise"),
        F.round(F.percentile(F.col("peak_ms") - F.col("start_ms"), 0.5), 1).alias("median_span_ms"), F.max_by("rise", "ordinal").alias("last_rise"),
    )
    return rounded(out, "median_rise", "last_rise")


@query(
    f"""WITH {RUNS} SELECT CAST(a.ordinal AS INTEGER) AS ordinal, count(*) AS n, round(count(b.symbol) / CAST(count(*) AS DOUBLE), 6) AS p_next, round(quantile_cont(a.rise, 0.5), 6) AS median_rise, round(quantile_cont(b.rise, 0.5), 6) AS median_next_rise
 FROM runs a LEFT JOIN runs b ON a.symbol = b.symbol AND b.ordinal = a.ordinal + 1 GROUP BY a.ordinal"""
)
def run_continuation(spark, sf_dir):
    """EVT-14: how often another run follows the nth."""
    w = Window.partitionBy("symbol").orderBy("ordinal")
    out = runs(spark, sf_dir).withColumn("__next", F.lead("rise").over(w)).groupBy("ordinal").agg(
        F.count("*").alias("n"), (F.count("__next") / F.count("*")).alias("p_next"), F.percentile("rise", 0.5).alias("median_rise"), F.percentile("__next", 0.5).alias("median_next_rise")
    )
    return rounded(out, "p_next", "median_rise", "median_next_rise")


@query(
    f"""WITH {RUNS}, e AS (SELECT event_id AS entry_id, symbol, ts_ms AS entry_ms FROM trades), a AS (SELECT e.entry_id, r.start_ms, r.peak_ms, r.peak_u, row_number() OVER w AS k, lead(r.start_ms) OVER w AS nxt
 FROM e JOIN runs r ON r.symbol = e.symbol AND r.start_ms >= e.entry_ms AND r.peak_ms <= e.entry_ms + {10 * DAY} WINDOW w AS (PARTITION BY e.entry_id ORDER BY r.start_ms, r.peak_ms)),
 t AS (SELECT entry_id, min(peak_ms) FILTER (k = 2) AS n_ms, min(peak_u) FILTER (k = 2) AS n_u, min(peak_ms) FILTER (nxt IS NULL OR nxt > peak_ms + {2 * DAY}) AS failed_ms FROM a GROUP BY entry_id),
 p AS (SELECT e.entry_id, k.ts_ms, k.price_u, t.failed_ms FROM e JOIN ticks k ON k.symbol = e.symbol AND k.ts_ms >= e.entry_ms AND k.ts_ms <= e.entry_ms + {10 * DAY} LEFT JOIN t USING (entry_id)),
 l AS (SELECT entry_id, max(ts_ms) AS l_ms, arg_max(price_u, ts_ms * 1000000000000::HUGEINT + price_u) AS l_u, min(ts_ms) FILTER (ts_ms >= failed_ms + {2 * DAY}) AS f_ms,
 arg_min(price_u, ts_ms * 1000000000000::HUGEINT + price_u) FILTER (ts_ms >= failed_ms + {2 * DAY}) AS f_u FROM p GROUP BY entry_id)
 SELECT entry_id, 'nth_run' AS rule, CAST(coalesce(n_ms, l_ms) AS DOUBLE) AS exit_ms, CAST(coalesce(n_u, l_u) AS DOUBLE) AS exit_u, CASE WHEN n_ms IS NOT NULL THEN 'run' WHEN l_ms IS NULL THEN 'no_path' ELSE 'horizon' END AS reason FROM e LEFT JOIN t USING (entry_id) LEFT JOIN l USING (entry_id)
 UNION ALL SELECT entry_id, 'run_fails', CAST(coalesce(f_ms, l_ms) AS DOUBLE), CAST(coalesce(f_u, l_u) AS DOUBLE), CASE WHEN f_ms IS NOT NULL THEN 'fail' WHEN l_ms IS NULL THEN 'no_path' ELSE 'horizon' END FROM e LEFT JOIN l USING (entry_id)"""
)
def run_exits(spark, sf_dir):
    """SIM-03: exits at the second run's peak, and when no further run follows."""
    out = I.run_exits(runs(spark, sf_dir), V.ticks(spark, sf_dir), entries(spark, sf_dir), nth=2, fail_ms=2 * DAY, horizon_ms=10 * DAY)
    return doubles(out, "exit_ms")


@query(
    f"""WITH {RUNS}, d AS (SELECT symbol, ordinal, peak_ms + {HOUR} AS at_ms, rise FROM runs), px AS (SELECT symbol, ts_ms, last(price_u ORDER BY event_id) AS price_u FROM ticks GROUP BY ALL),
 n AS (SELECT d.*, px.price_u AS entry_u FROM d ASOF LEFT JOIN px ON d.symbol = px.symbol AND d.at_ms >= px.ts_ms),
 s AS (SELECT *, price_u < lag(price_u) OVER w AS down, lag(ts_ms) OVER w AS p_ms FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, event_id)),
 p AS (SELECT n.symbol, n.ordinal, s.ts_ms, s.event_id, s.price_u, coalesce(s.down AND s.p_ms >= n.at_ms, false) AS down FROM n JOIN s ON s.symbol = n.symbol AND s.ts_ms >= n.at_ms AND s.ts_ms <= n.at_ms + {6 * DAY}),
 x AS (SELECT symbol, ordinal, coalesce(first(price_u ORDER BY ts_ms, event_id) FILTER (down), last(price_u ORDER BY ts_ms, event_id)) AS exit_u, coalesce(min(ts_ms) FILTER (down), max(ts_ms)) AS exit_ms FROM p GROUP BY ALL)
 SELECT n.symbol, CAST(n.ordinal AS INTEGER) AS ordinal, round(n.rise * {NUDGE}, 6) AS hindsight_rise, round((x.exit_u / nullif(n.entry_u, 0)::DOUBLE - 1) * {NUDGE}, 6) AS captured, CAST(x.exit_ms - n.at_ms AS DOUBLE) AS hold_ms FROM n LEFT JOIN x USING (symbol, ordinal)"""
)
def capturable_returns(spark, sf_dir):
    """SIM-04: what can be had of a run when it is entered after it shows and left at the first lower price."""
    found = runs(spark, sf_dir).select("symbol", "ordinal", (F.col("peak_ms") + HOUR).alias("entry_ms"), "rise").withColumn("entry_id", F.struct("symbol", "ordinal"))
    priced = asof_join(found.withColumn("ts_ms", F.col("entry_ms")), V.ticks(spark, sf_dir), "symbol", "ts_ms", ["price_u"], tie="event_id").withColumnRenamed("price_u", "entry_u").drop("right_ts_ms", "ts_ms")
    out = I.downtick_exits(V.ticks(spark, sf_dir), priced, 6 * DAY, ["event_id"])
    gain = ratio(F.col("exit_u"), F.col("entry_u")) - 1
    out = out.select("symbol", "ordinal", F.col("rise").alias("hindsight_rise"), gain.alias("captured"), (F.col("exit_ms") - F.col("entry_ms")).cast("double").alias("hold_ms"))
    return rounded(out, "hindsight_rise", "captured", nudge=True)


@query(
    f"""WITH {RANKS}, s AS (SELECT symbol, snap_ms, quantile_cont(amount, 0.5) AS price, count(DISTINCT amount) > 1 AS conflict FROM ranks GROUP BY ALL)
 SELECT symbol, count(*) AS n_snaps, count(*) FILTER (conflict) AS n_conflicts, round(avg(price), 4) AS mean_price FROM s GROUP BY symbol"""
)
def price_series_multi(spark, sf_dir):
    """EVT-12: one price a snapshot over several lists, and how often the lists disagree."""
    one = V.rankings(spark, sf_dir).groupBy("symbol", "snap_ms").agg(F.percentile("amount", 0.5).alias("price"), (F.countDistinct("amount") > 1).alias("conflict"))
    out = one.groupBy("symbol").agg(F.count("*").alias("n_snaps"), F.count_if("conflict").alias("n_conflicts"), F.avg("price").alias("mean_price"))
    return rounded(out, "mean_price", digits=4)


@query(
    f"""WITH {RANKS}, t AS (SELECT ranking_type, snap_ms, idx, list(symbol ORDER BY symbol) AS top FROM numbered WHERE rank <= 20 GROUP BY ALL), w AS (SELECT a.ranking_type, a.snap_ms, a.top AS last, first(b.top ORDER BY b.snap_ms) AS first, count(*) AS n
 FROM t a JOIN t b ON a.ranking_type = b.ranking_type AND b.snap_ms BETWEEN a.snap_ms - {3 * DAY} AND a.snap_ms GROUP BY ALL)
 SELECT r.ranking_type, r.snap_ms, r.symbol, CAST(CASE WHEN w.n >= 2 THEN len(list_filter(w.last, lambda x: NOT list_contains(w.first, x) AND x <> r.symbol)) END AS DOUBLE) AS pressure FROM numbered r JOIN w USING (ranking_type, snap_ms) WHERE r.rank <= 20"""
)
def handoff_pressure(spark, sf_dir):
    """WIN-35: how many other symbols have come into the top since the window's first snapshot."""
    inside = V.rankings(spark, sf_dir).where("rank <= 20").select("ranking_type", "snap_ms", "symbol")
    tops = inside.groupBy("ranking_type", "snap_ms").agg(F.collect_set("symbol").alias("top"))
    w = Window.partitionBy("ranking_type").orderBy("snap_ms").rangeBetween(-3 * DAY, 0)
    seen = tops.select("ranking_type", "snap_ms", "top", F.first("top").over(w).alias("first"), F.count("*").over(w).alias("n"))
    fresh = F.size(F.array_except(F.array_except("top", "first"), F.array("symbol")))
    out = inside.join(seen, ["ranking_type", "snap_ms"])
    return out.select("ranking_type", "snap_ms", "symbol", F.when(F.col("n") >= 2, fresh).cast("double").alias("pressure"))
