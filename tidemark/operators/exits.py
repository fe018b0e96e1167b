"""Exits on signals other than the price: rankings, order books, the tape; and features of what came before an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import ratio
from tidemark.operators.baselines import session_vwap
from tidemark.operators.execution import simulate_exits
from tidemark.operators.temporal import asof_join, range_pairs

PAST = (Window.unboundedPreceding, -1)


def _fires(kind: str, bound: float, value: Column, time: Column) -> Column:
    """Whether a row of a signal fires, told from it and the rows before."""
    if kind == "stall":  # no new best (lowest) value for `bound` ms
        return (value >= F.col("__best.v")) & (time - F.col("__best.t") >= bound)
    if kind == "worsen":
        return value >= F.col("__best.v") + bound
    if kind == "drop":  # to a share of the peak
        return (F.col("__peak") > 0) & (value <= bound * F.col("__peak"))
    if kind == "rise":  # to a multiple of the first value
        return F.col("__peak").isNotNull() & (value >= bound * F.col("__first"))
    raise ValueError(f"no such kind of rule: {kind}")


def _ended(entries: DataFrame, prices: DataFrame, horizon_ms: int, tie: str) -> DataFrame:
    """(entry_id, last_ms, last_u): the last price within the horizon, if any."""
    ends = entries.select("entry_id", "symbol", "entry_ms", (F.col("entry_ms") + horizon_ms).alias("ts_ms"))
    return asof_join(ends, prices, "symbol", "ts_ms", ["price_u"], tie=tie).where("right_ts_ms >= entry_ms").select("entry_id", F.col("right_ts_ms").alias("last_ms"), F.col("price_u").alias("last_u"))


def _outcome(rows: DataFrame, known: Column) -> DataFrame:
    available = F.coalesce(known, F.lit(False)) & (F.col("hit.price_u").isNotNull() | F.col("last_u").isNotNull())
    pick = lambda a, b: F.when(available, F.coalesce(F.col(a), F.col(b)))
    return rows.select("entry_id", "rule", pick("hit.price_u", "last_u").alias("exit_u"), pick("hit.t", "last_ms").alias("exit_ms"), (available & F.col("hit.t").isNotNull()).alias("filled"), available.alias("available"))


def signal_exits(prices: DataFrame, signals: DataFrame, entries: DataFrame, rules: dict[str, tuple[str, float]], *, horizon_ms: int, least: int = 3, tie: str = "event_id") -> DataFrame:
    """(entry_id, rule, exit_u, exit_ms, filled, available) for every entry (entry_id, symbol, entry_ms) and rule.

    signals (rule, symbol, ts_ms, value) hold at most one value for a rule, symbol and time. rules name a kind and a
    bound: stall, worsen, drop or rise (see _fires). The first row within the horizon that fires and has a price at or
    before it is the exit; without one, the last price within the horizon. An entry with fewer than `least` values, or a
    rise from no positive value, isn't available. All rules take one pass: prices are put to signals once per symbol,
    and entries meet their signals by key and time bucket."""
    priced = asof_join(signals.where("value is not null"), prices, "symbol", "ts_ms", ["price_u"], tie=tie).drop("right_ts_ms")
    asked = entries.select("entry_id", "symbol", F.col("entry_ms").alias("ts_ms"))
    w = Window.partitionBy("entry_id", "r_rule").orderBy("r_ts_ms")
    value, time = F.col("r_value").cast("double"), F.col("r_ts_ms")
    seen = range_pairs(asked, priced, "symbol", "ts_ms", -1, horizon_ms).withColumns(
        {"__best": F.min(F.struct(value.alias("v"), time.alias("t"))).over(w.rowsBetween(*PAST)), "__peak": F.max(value).over(w.rowsBetween(*PAST)), "__first": F.first(value).over(w)}
    )
    fires = F.lit(False)
    for name, (kind, bound) in rules.items():
        fires = F.when(F.col("r_rule") == name, _fires(kind, bound, value, time)).otherwise(fires)
    hit = F.min(F.when(fires & F.col("r_price_u").isNotNull(), F.struct(time.alias("t"), F.col("r_price_u").alias("price_u"))))
    told = seen.groupBy("entry_id", F.col("r_rule").alias("rule")).agg(hit.alias("hit"), F.count("*").alias("n"), F.min("__first").alias("first"))
    rows = entries.select("entry_id", F.explode(F.array(*map(F.lit, rules))).alias("rule")).join(told, ["entry_id", "rule"], "left").join(_ended(entries, prices, horizon_ms, tie), "entry_id", "left")
    rises = [name for name, (kind, _) in rules.items() if kind == "rise"]
    return _outcome(rows, (F.col("n") >= least) & (~F.col("rule").isin(rises) | (F.col("first") > 0)))


def tape_fade_exits(prices: DataFrame, tape: DataFrame, entries: DataFrame, *, bucket_ms: int, share: float, horizon_ms: int, least: int = 3, tie: str = "event_id") -> DataFrame:
    """As signal_exits, rule tape_fade: the end of the first closed bucket of the tape (symbol, ts_ms, qty_u) whose volume is
    at most `share` of the largest before. Buckets count from the entry; empty ones have no volume."""
    asked = entries.select("entry_id", "symbol", F.col("entry_ms").alias("ts_ms"))
    seen = range_pairs(asked, tape.select("symbol", "ts_ms", "qty_u"), "symbol", "ts_ms", -1, horizon_ms)
    volumes = seen.groupBy("entry_id", F.floor((F.col("r_ts_ms") - F.col("ts_ms")) / bucket_ms).alias("k")).agg(F.sum("r_qty_u").alias("v"), F.count("*").alias("n"))
    grid = asked.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(horizon_ms // bucket_ms - 1).cast("long"))))
    w = Window.partitionBy("entry_id").orderBy("k")
    dense = grid.join(volumes, ["entry_id", "k"], "left").withColumn("v", F.coalesce("v", F.lit(0))).withColumn("peak", F.max("v").over(w.rowsBetween(*PAST)))
    fired = dense.where((F.col("peak") > 0) & (F.col("v") <= share * F.col("peak"))).select("entry_id", "symbol", (F.col("ts_ms") + (F.col("k") + 1) * bucket_ms).alias("ts_ms"))
    hit = F.min(F.struct(F.col("ts_ms").alias("t"), "price_u")).alias("hit")
    hits = asof_join(fired, prices, "symbol", "ts_ms", ["price_u"], tie=tie).where("price_u is not null").groupBy("entry_id").agg(hit)
    counted = volumes.groupBy("entry_id").agg(F.sum("n").alias("n"))
    rows = entries.select("entry_id", F.lit("tape_fade").alias("rule")).join(counted, "entry_id", "left").join(hits, "entry_id", "left").join(_ended(entries, prices, horizon_ms, tie), "entry_id", "left")
    return _outcome(rows, F.col("n") >= least)


def threshold_exits(path: DataFrame, signal: DataFrame, entries: DataFrame, *, threshold: float, above: bool, horizon_ms: int, trail: float | None = None) -> DataFrame:
    """entries (entry_id, symbol, entry_ms, entry_u) with exit_u, exit_ms, reason, mfe, mae and signal_defined.

    The exit is the close of the first bar at which the latest value of signal (symbol, ts_ms, value; null values are
    passed over) has reached the threshold; else the last close within the horizon. If no bar has a value and `trail` is
    given, a trailing exit takes over. mfe and mae are the extremes up to the exit, from the entry's price."""
    bars = asof_join(path, signal.where("value is not null"), "symbol", "ts_ms", ["value"]).select("symbol", "ts_ms", "high_u", "low_u", "close_u", "value")
    pairs = range_pairs(entries.withColumnRenamed("entry_ms", "ts_ms"), bars, "symbol", "ts_ms", -1, horizon_ms)
    w = Window.partitionBy("entry_id").orderBy("r_ts_ms")
    at = F.struct(F.col("r_ts_ms").alias("t"), F.col("r_close_u").cast("double").alias("px"), F.max("r_high_u").over(w).alias("high"), F.min("r_low_u").over(w).alias("low"))
    reached = F.col("r_value") >= threshold if above else F.col("r_value") <= threshold
    told = pairs.withColumn("__at", at).groupBy("entry_id").agg(F.min(F.when(reached, F.col("__at"))).alias("hit"), F.max("__at").alias("end"), F.count("r_value").alias("n"))
    out = entries.join(told, "entry_id", "left").withColumn("__x", F.coalesce("hit", "end"))
    reason = F.when(F.col("hit").isNotNull(), "signal").when(F.col("end").isNotNull(), "horizon").otherwise("no_path")
    out = out.select(
        *entries.columns, F.col("__x.px").alias("exit_u"), F.col("__x.t").alias("exit_ms"), reason.alias("reason"), (ratio(F.greatest("__x.high", "entry_u"), F.col("entry_u")) - 1).alias("mfe"),
        (ratio(F.least("__x.low", "entry_u"), F.col("entry_u")) - 1).alias("mae"), (F.coalesce("n", F.lit(0)) > 0).alias("signal_defined"),
    )
    if trail is None:
        return out
    other = simulate_exits(path, entries, horizon_ms=horizon_ms, trail=trail).select("entry_id", F.struct("exit_u", "exit_ms", "reason").alias("__o"))
    falls = ~F.col("signal_defined") & (F.col("reason") != "no_path")
    return out.join(other, "entry_id").withColumns({"exit_u": F.when(falls, F.col("__o.exit_u")).otherwise(F.col("exit_u")), "exit_ms": F.when(falls, F.col("__o.exit_ms")).otherwise(F.col("exit_ms")), "reason": F.when(falls, F.concat(F.lit("fallback_"), "__o.reason")).otherwise(F.col("reason"))}).drop("__o")


def gap_permutation(pairs: DataFrame, draws: int) -> DataFrame:
    """One row of pairs (pair, real, placebo): n_pairs, the observed gap of medians (placebo - real), and its two-sided
    p-value when the two values of each pair are exchanged at random, (exceeding + 1) / (draws + 1).

    Exchanges come from a hash of pair and draw, so every draw is one group of an aggregate."""
    swap = F.md5(F.concat_ws("-", F.col("pair").cast("string"), F.col("draw").cast("string"))) < "8"
    drawn = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("__s", swap & (F.col("draw") > 0))
    real, placebo = F.when(F.col("__s"), F.col("placebo")).otherwise(F.col("real")), F.when(F.col("__s"), F.col("real")).otherwise(F.col("placebo"))
    gaps = drawn.groupBy("draw").agg((F.percentile(placebo, 0.5) - F.percentile(real, 0.5)).alias("gap"), F.count("*").alias("n"))
    observed = gaps.where("draw = 0").select(F.col("gap").alias("observed_gap"), F.col("n").alias("n_pairs"))
    beyond = F.count_if(F.abs("gap") >= F.abs("observed_gap"))
    return gaps.where("draw > 0").crossJoin(F.broadcast(observed)).groupBy("n_pairs", "observed_gap").agg(((beyond + 1) / (F.count("*") + 1)).alias("p_two_sided"))


def precursor_features(events: DataFrame, bars: DataFrame, *, step_ms: int, day_ms: int, windows: tuple[int, ...] = (5, 15, 30, 60), base: int = 240) -> DataFrame:
    """events (event_id, symbol, ts_ms) with features of the bars up to the event, by one wide aggregate over the trailing
    bars; times and spans are in steps, counted back from the last bar seen (the cutoff).

    Absent bars have no volume. Volumes are compared, as logarithms, with the `base` steps before each window; a true
    range looks back only within its window. Null where bars are lacking or a divisor isn't positive."""
    order, in_day = Window.partitionBy("symbol").orderBy("ts_ms"), Window.partitionBy("symbol", "day").orderBy("ts_ms")
    known = bars.select("symbol", "ts_ms", "open_u", "high_u", "low_u", "close_u", "vol_qu", F.floor((F.col("ts_ms") - step_ms) / day_ms).alias("day")).withColumns(
        {"n": F.row_number().over(order), "prev_u": F.lag("close_u").over(order), "prev_ms": F.lag("ts_ms").over(order), "first_ms": F.min("ts_ms").over(in_day), "hod_u": F.max("high_u").over(in_day)}
    )
    known = session_vwap(known.withColumn("fresh", F.col("high_u") > F.coalesce(F.max("high_u").over(in_day.rowsBetween(*PAST)), F.lit(0))), "day")
    at = asof_join(events.select("event_id", "symbol", "ts_ms"), known, "symbol", "ts_ms", ["n", "close_u", "prev_ms", "first_ms", "hod_u", "vwap_u", "day"])
    longest = max(*windows, 60) + base
    seen = range_pairs(at.where("n is not null").select("event_id", "symbol", F.col("right_ts_ms").alias("ts_ms"), "day"), known, "symbol", "ts_ms", -longest * step_ms, 0)
    age, x, close = (F.col("ts_ms") - F.col("r_ts_ms")) / step_ms, F.log1p("r_vol_qu"), F.col("close_u")
    span = F.col("r_high_u") - F.col("r_low_u")
    reach = F.greatest(span, F.abs(F.col("r_high_u") - F.col("r_prev_u")), F.abs(F.col("r_low_u") - F.col("r_prev_u")))

    def ranges(near: int, far: int) -> dict[str, Column]:
        inside = (age >= near) & (age < far)
        tr = F.when(F.col("r_prev_ms") > F.col("ts_ms") - far * step_ms, reach).otherwise(span)
        return {f"n_{near}_{far}": F.count_if(inside), f"tr_{near}_{far}": F.sum(F.when(inside, tr))}

    sums = {}
    for w in sorted({*windows, 15, 60}):
        inside, earlier = age < w, (age >= w) & (age < w + base)
        sums |= ranges(0, w) | {
            f"vol_{w}": F.sum(F.when(inside, F.col("r_vol_qu")).otherwise(0)), f"x_{w}": F.sum(F.when(inside, x).otherwise(0.0)), f"printed_{w}": F.count_if(inside & (F.col("r_vol_qu") > 0)),
            f"bx_{w}": F.sum(F.when(earlier, x).otherwise(0.0)), f"bxx_{w}": F.sum(F.when(earlier, x * x).otherwise(0.0)), f"bvol_{w}": F.sum(F.when(earlier, F.col("r_vol_qu")).otherwise(0)),
            f"from_{w}": F.min(F.when(inside, F.struct(F.col("r_ts_ms").alias("t"), F.col("r_close_u").alias("c")))), f"high_{w}": F.max(F.when(inside, F.col("r_high_u"))), f"low_{w}": F.min(F.when(inside, F.col("r_low_u"))),
        }
    today = (F.col("r_day") == F.col("day")) & (age < 30)
    sums |= ranges(15, 60) | {"slope": F.sum(F.when(age < 30, (29 - age - 14.5) * x).otherwise(0.0)), "top_60": F.max(F.when(age < 60, x)), "new_highs": F.count_if(today & F.col("r_fresh")), "ups": F.avg(F.when(today, (F.col("r_close_u") > F.col("r_open_u")).cast("double")))}
    told = seen.groupBy("event_id").agg(*[c.alias(name) for name, c in sums.items()])
    rows = at.join(told, "event_id", "left")

    def spread(w: int) -> Column:  # deviations of rounding size count as none
        variance = (F.col(f"bxx_{w}") - F.col(f"bx_{w}") * F.col(f"bx_{w}") / base) / (base - 1)
        return F.when(variance > 1e-9, F.sqrt(variance))

    atr = lambda near, far: F.when(F.col(f"n_{near}_{far}") >= 2, ratio(F.col(f"tr_{near}_{far}") / F.col(f"n_{near}_{far}"), close))
    wide = lambda w: ratio(F.col(f"high_{w}") - F.col(f"low_{w}"), close)
    out = {"cutoff_ms": F.col("right_ts_ms"), "n_bars_pre": F.coalesce("n", F.lit(0)).cast("long")}
    for w in windows:
        out |= {
            f"vol_sum_{w}": F.col(f"vol_{w}"), f"vol_z_{w}": (F.col(f"x_{w}") / w - F.col(f"bx_{w}") / base) / spread(w), f"vol_ratio_{w}": F.when(F.col(f"bvol_{w}") > 0, F.col(f"vol_{w}") / w / (F.col(f"bvol_{w}") / base)),
            f"ret_{w}": ratio(close, F.col(f"from_{w}.c")) - 1, f"atr_pct_{w}": atr(0, w), f"range_pct_{w}": wide(w), f"no_print_ratio_{w}": 1 - F.col(f"printed_{w}") / w,
        }
    both = (atr(0, 15) > 0) & (atr(15, 60) > 0)
    start = F.col("day") * day_ms
    out |= {
        "vol_slope_30": F.col("slope") / 2247.5, "vol_bar_z_max_60": (F.col("top_60") - F.col("bx_60") / base) / spread(60), "coil_score": F.when(both, F.log(atr(15, 60) / atr(0, 15))), "nr_ratio": F.when(wide(60) > 0, wide(15) / wide(60)),
        "dist_from_vwap": F.when(F.col("vwap_u") > 0, close / F.col("vwap_u") - 1), "dist_from_hod": F.when(F.col("hod_u") > 0, close / F.col("hod_u") - 1), "up_bar_ratio_30": F.col("ups"), "new_high_count_30": F.col("new_highs"),
        "steps_since_last_print": F.when(F.col("n").isNotNull(), F.coalesce((F.col("right_ts_ms") - F.col("prev_ms")) / step_ms - 1, F.lit(0.0))), "session_print_age": (F.col("right_ts_ms") - F.col("first_ms")) / step_ms, "session_first_print_lead": (F.col("first_ms") - step_ms - start) / step_ms,
    }
    return rows.select("event_id", "symbol", *[c.alias(name) for name, c in out.items()])
