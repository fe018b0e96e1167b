"""Events within trading days: threshold moves with labels, rising runs, and exits on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import ratio
from tidemark.operators.temporal import range_pairs

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def day_closes(bars: DataFrame, regular: Column) -> DataFrame:
    """(symbol, day, prev_close_u, next_open_u): of each symbol's day, the close of the day before (its last regular bar,
    else its last bar) and the open of the next day's first bar. bars have symbol, day, ts_ms, open_u, close_u."""
    last = lambda c: F.max(F.when(c, F.struct("ts_ms", "close_u")))["close_u"]
    days = bars.groupBy("symbol", "day").agg(F.coalesce(last(regular), last(F.lit(True))).alias("c"), F.min(F.struct("ts_ms", "open_u"))["open_u"].alias("o"))
    w = Window.partitionBy("symbol").orderBy("day")
    return days.select("symbol", "day", F.lag("c").over(w).alias("prev_close_u"), F.lead("o").over(w).alias("next_open_u"))


def detect_events(
    bars: DataFrame, regular: Column, *, rise: float, day_rise: float, look_ms: int, dump_ms: int, gap_ms: int, pre: tuple[int, int], rvol_min: float | None = None,
    no_day_rise: Column | None = None, least_pre: int = 10, dump: float = 0.2, keep: float = 0.5, instant: float = 0.5, drift: float = 0.05, coil: float = 0.1,
) -> DataFrame:
    """The first bar of each symbol's day whose close is `rise` above the lowest close of the last look_ms (win), or
    `day_rise` above the close of the day before (day), with labels from the whole day.

    bars: symbol, day, ts_ms, open_u, high_u, low_u, close_u and, with rvol_min, rvol: a bar with a known smaller one
    doesn't count. no_day_rise: where the close before says nothing, as after a split. Labels: peak (the highest high
    from the event on, the earliest), hod of the day, returns to the peak and the day's last close, the share of the rise
    that is given back, how long to the peak, gaps of gap_ms or more after the event, the next day's opening gap.
    shape: instant, if the bar alone makes a share of the rise; else by the bars of (t - pre[0], t - pre[1]]'s kind
    [t - pre[0], t - pre[1]): ramp if they drift up, coil if they keep a narrow range, mixed otherwise or if there are
    too few. outcome: dump, fade or hold. All windows are over one symbol's day, so one shuffle serves them all."""
    at = Window.partitionBy("symbol", "day").orderBy("ts_ms")
    whole = Window.partitionBy("symbol", "day")
    known = bars.join(day_closes(bars, regular), ["symbol", "day"])
    base = F.col("prev_close_u") if no_day_rise is None else F.when(~no_day_rise, F.col("prev_close_u"))
    low = F.min("close_u").over(at.rangeBetween(-look_ms, 0))
    win = F.coalesce((low > 0) & (F.col("close_u") >= low * (1 + rise)), F.lit(False))
    day = F.coalesce((base > 0) & (F.col("close_u") >= base * (1 + day_rise)), F.lit(False))
    gated = F.lit(True) if rvol_min is None else F.coalesce(F.col("rvol") >= rvol_min, F.lit(True))
    marked = known.withColumns({"__win": win, "__day": day}).withColumn("__hit", (F.col("__win") | F.col("__day")) & gated)
    marked = marked.withColumn("t0_ms", F.min(F.when(F.col("__hit"), F.col("ts_ms"))).over(whole)).where("t0_ms is not null")
    later = F.col("ts_ms") >= F.col("t0_ms")
    peak = F.max(F.when(later, F.struct(F.col("high_u").alias("u"), (-F.col("ts_ms")).alias("t")))).over(whole)
    marked = marked.withColumns({"__peak": peak, "__gap": F.when(F.lag("ts_ms").over(at) >= F.col("t0_ms"), F.col("ts_ms") - F.lag("ts_ms").over(at))})
    peak_ms = -F.col("__peak.t")
    here, before = F.col("ts_ms") == F.col("t0_ms"), (F.col("ts_ms") >= F.col("t0_ms") - pre[0]) & (F.col("ts_ms") < F.col("t0_ms") - pre[1])
    falls = (F.col("ts_ms") >= peak_ms) & (F.col("ts_ms") <= peak_ms + dump_ms)
    pick = lambda c, column: F.max(F.when(c, F.col(column)))
    ends = lambda c, f: f(F.when(c, F.struct("ts_ms", "close_u")))["close_u"]
    told = marked.groupBy("symbol", "day", "t0_ms", "prev_close_u", "next_open_u", F.col("__peak.u").alias("peak_u"), peak_ms.alias("peak_ms")).agg(
        pick(here, "__win").alias("win"), pick(here, "__day").alias("by_day"), pick(here, "open_u").alias("t0_open_u"), pick(here, "close_u").alias("t0_close_u"),
        F.max("high_u").alias("hod_u"), ends(F.lit(True), F.max).alias("last_u"), F.min(F.when(falls, F.col("low_u"))).alias("fall_u"),
        F.count_if(F.col("__gap") >= gap_ms).alias("n_gaps"), F.count_if(before).alias("n_pre"), ends(before, F.min).alias("pre_first_u"), ends(before, F.max).alias("pre_last_u"),
        pick(before, "high_u").alias("pre_high_u"), F.min(F.when(before, F.col("low_u"))).alias("pre_low_u"),
    )
    r = lambda a, b: ratio(F.col(a), F.col(b))
    out = told.withColumns(
        {
            "kind": F.when(F.col("win") & F.col("by_day"), "both").when(F.col("win"), "win").otherwise("day"),
            "peak_ret": r("peak_u", "t0_close_u") - 1, "ret_close": r("last_u", "t0_close_u") - 1, "retrace": ratio(F.col("peak_u") - F.col("last_u"), F.col("peak_u") - F.col("t0_close_u")),
            "to_peak_ms": F.col("peak_ms") - F.col("t0_ms"), "next_gap": r("next_open_u", "last_u") - 1, "__bar": r("t0_close_u", "t0_open_u") - 1, "__drift": r("pre_last_u", "pre_first_u") - 1,
            "__range": ratio(F.col("pre_high_u") - F.col("pre_low_u"), F.col("pre_last_u")),
        }
    )
    shape = F.when(F.col("__bar") >= instant * rise, "instant").when(F.col("n_pre") < least_pre, "mixed").when(F.col("__drift") >= drift, "ramp").when(F.col("__range") <= coil, "coil").otherwise("mixed")
    outcome = F.when(r("fall_u", "peak_u") - 1 <= -dump, "dump").when((F.col("peak_ret") > 0) & (F.col("ret_close") < keep * F.col("peak_ret")), "fade").otherwise("hold")
    return out.withColumns({"shape": shape, "outcome": outcome})


def rising_runs(series: DataFrame, rise: float, order: list[str]) -> DataFrame:
    """(symbol, ordinal, start_ms, peak_ms, start_u, peak_u, rise): maximal runs of prices that don't fall, from the last
    print before they rise, whose rise is at least `rise`; numbered within the symbol."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", *order)
    falls = F.coalesce((F.col("price_u") < F.lag("price_u").over(w)).cast("int"), F.lit(0))
    runs = series.withColumn("__f", falls).withColumn("__run", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("ts_ms", *order, "price_u")
    found = runs.groupBy("symbol", "__run").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    out = found.select("symbol", F.col("a.ts_ms").alias("start_ms"), F.col("b.ts_ms").alias("peak_ms"), F.col("a.price_u").alias("start_u"), F.col("b.price_u").alias("peak_u"))
    out = out.withColumn("rise", ratio(F.col("peak_u"), F.col("start_u")) - 1).where(F.col("rise") >= rise)
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy("symbol").orderBy("start_ms", "peak_ms", "start_u")))


def run_exits(runs: DataFrame, series: DataFrame, entries: DataFrame, *, nth: int, fail_ms: int, horizon_ms: int) -> DataFrame:
    """(entry_id, rule, exit_ms, exit_u, reason) of two rules for every entry (entry_id, symbol, entry_ms).

    nth_run: at the peak of the nth run that begins after the entry and peaks within the horizon. run_fails: fail_ms
    after the first such peak that no further run follows within fail_ms, at the first price from then on. Without them
    the last price within the horizon; without prices: no_path."""
    asked = entries.select("entry_id", "symbol", F.col("entry_ms").alias("ts_ms"))
    after = range_pairs(asked, runs.select("symbol", F.col("start_ms").alias("ts_ms"), "peak_ms", "peak_u"), "symbol", "ts_ms", -1, horizon_ms)
    after = after.where(F.col("r_peak_ms") <= F.col("ts_ms") + horizon_ms)
    w = Window.partitionBy("entry_id").orderBy("r_ts_ms", "r_peak_ms")
    next_start = F.lead("r_ts_ms").over(w)
    after = after.withColumns({"k": F.row_number().over(w), "__fails": next_start.isNull() | (next_start > F.col("r_peak_ms") + fail_ms)})
    told = after.groupBy("entry_id").agg(
        F.min(F.when(F.col("k") == nth, F.struct("r_peak_ms", F.col("r_peak_u").cast("double").alias("u")))).alias("nth"), F.min(F.when(F.col("__fails"), F.col("r_peak_ms"))).alias("failed_ms")
    )
    path = range_pairs(asked, series.select("symbol", "ts_ms", "price_u"), "symbol", "ts_ms", -1, horizon_ms).join(told, "entry_id", "left")
    price = F.struct(F.col("r_ts_ms").alias("t"), F.col("r_price_u").cast("double").alias("u"))
    ended = path.groupBy("entry_id").agg(F.max(price).alias("last"), F.min(F.when(F.col("r_ts_ms") >= F.col("failed_ms") + fail_ms, price)).alias("fail"))
    rows = entries.select("entry_id").join(told, "entry_id", "left").join(ended, "entry_id", "left")
    none = F.when(F.col("last").isNull(), "no_path").otherwise("horizon")
    rules = F.array(
        F.struct(F.lit("nth_run").alias("rule"), F.coalesce("nth.r_peak_ms", "last.t").alias("exit_ms"), F.coalesce("nth.u", "last.u").alias("exit_u"), F.when(F.col("nth").isNotNull(), "run").otherwise(none).alias("reason")),
        F.struct(F.lit("run_fails").alias("rule"), F.coalesce("fail.t", "last.t").alias("exit_ms"), F.coalesce("fail.u", "last.u").alias("exit_u"), F.when(F.col("fail").isNotNull(), "fail").otherwise(none).alias("reason")),
    )
    return rows.select("entry_id", F.inline(rules))


def downtick_exits(series: DataFrame, entries: DataFrame, horizon_ms: int, order: list[str]) -> DataFrame:
    """entries (entry_id, symbol, entry_ms) with exit_ms and exit_u: the first price below the one before it, both at or
    after the entry and within the horizon; else the last price; null without prices."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", *order)
    stepped = series.withColumns({"__down": F.col("price_u") < F.lag("price_u").over(w), "prev_ms": F.lag("ts_ms").over(w)}).select("symbol", "ts_ms", "price_u", *order, "__down", "prev_ms")
    path = range_pairs(entries.select("entry_id", "symbol", F.col("entry_ms").alias("ts_ms")), stepped, "symbol", "ts_ms", -1, horizon_ms)
    price = F.struct("r_ts_ms", *[f"r_{c}" for c in order], "r_price_u")
    down = F.col("r___down") & (F.col("r_prev_ms") >= F.col("ts_ms"))
    told = path.groupBy("entry_id").agg(F.min(F.when(down, price)).alias("d"), F.max(price).alias("l")).withColumn("__x", F.coalesce("d", "l"))
    return entries.join(told.select("entry_id", F.col("__x.r_ts_ms").alias("exit_ms"), F.col("__x.r_price_u").alias("exit_u")), "entry_id", "left")
