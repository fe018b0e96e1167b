"""Daily and intraday baselines of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import log_return, ratio


def true_range(bars: DataFrame, time: str = "day") -> DataFrame:
    """bars with true_range_u: the largest of high - low and the distances of both from the close before."""
    prev = F.lag("close_u").over(Window.partitionBy("symbol").orderBy(time))
    span = F.col("high_u") - F.col("low_u")
    return bars.withColumn("true_range_u", F.greatest(span, F.coalesce(F.abs(F.col("high_u") - prev), span), F.coalesce(F.abs(F.col("low_u") - prev), span)))


def daily_baseline(bars: DataFrame, window: int = 20, time: str = "day") -> DataFrame:
    """bars with statistics of the symbol's `window` bars strictly before each: days, adv (floored mean volume), ATR
    (floored), mean and sample deviation of volume and of its logarithm (positive volumes only)."""
    w = Window.partitionBy("symbol").orderBy(time).rowsBetween(-window, -1)
    log = F.when(F.col("vol") > 0, F.log("vol"))
    ranged = true_range(bars, time).withColumn("__log", log)
    return ranged.withColumns(
        {
            "n_days": F.count("*").over(w),
            "adv": F.floor(F.avg("vol").over(w)).cast("long"),
            "atr_u": F.floor(F.sum("true_range_u").over(w) / F.count("true_range_u").over(w)).cast("long"),
            "vol_mean": F.avg("vol").over(w),
            "vol_std": F.stddev_samp("vol").over(w),
            "log_mean": F.avg("__log").over(w),
            "log_std": F.stddev_samp("__log").over(w),
        }
    ).drop("__log")


def volume_z(log: bool = True):
    """(ln v - mean) / deviation of a row of daily_baseline; null without a positive deviation."""
    value, mean, std = (F.log("vol"), "log_mean", "log_std") if log else (F.col("vol"), "vol_mean", "vol_std")
    return F.when(F.col(std) > 0, (value - F.col(mean)) / F.col(std))


def screen_daily(bars: DataFrame, ret_bp: int, z_min: float, window: int = 20, time: str = "day") -> DataFrame:
    """Bars whose close is ret_bp or more above the close before, in integer arithmetic, with volume_z at least z_min."""
    prev = F.lag("close_u").over(Window.partitionBy("symbol").orderBy(time))
    based = daily_baseline(bars, window, time).withColumn("prev_close_u", prev).withColumn("volume_z", volume_z())
    rose = (F.col("close_u") - F.col("prev_close_u")) * 10_000 >= ret_bp * F.col("prev_close_u")
    return based.where((F.col("n_days") >= window) & rose & (F.col("volume_z") >= z_min))


def session_vwap(bars: DataFrame, session: str) -> DataFrame:
    """bars with vwap_u: running floor(sum(tp * v) / sum(v)) within symbol and session, tp = (high + low + close) div 3;
    before the first volume, tp itself. Exact integers."""
    w = Window.partitionBy("symbol", session).orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    tp = F.expr("(high_u + low_u + close_u) div 3")
    out = bars.withColumn("__tp", tp).withColumn("__num", F.sum(F.col("__tp").cast("decimal(18,0)") * F.col("vol_qu").cast("decimal(18,0)")).over(w)).withColumn("__den", F.sum("vol_qu").over(w))
    return out.withColumn("vwap_u", F.expr("cast(case when __den > 0 then __num div __den else __tp end as bigint)")).drop("__tp", "__num", "__den")


def volume_curve(bars: DataFrame, session: str, minute: str, date: str, min_days: int) -> DataFrame:
    """(symbol, session, minute, mean_vol, mean_cum, n_days): what a symbol has traded on average at, and up to, each
    place of a session, over dates that have the session. Absent bars count as no volume. Fewer than min_days: none."""
    days = bars.groupBy("symbol", session).agg(F.countDistinct(date).alias("n_days"))
    at = bars.groupBy("symbol", session, minute).agg(F.sum("vol_qu").alias("v"))
    w = Window.partitionBy("symbol", session).orderBy(minute).rowsBetween(Window.unboundedPreceding, 0)
    out = at.withColumn("cum", F.sum("v").over(w)).join(days.where(F.col("n_days") >= min_days), ["symbol", session])
    return out.select("symbol", session, minute, (F.col("v") / F.col("n_days")).alias("mean_vol"), (F.col("cum") / F.col("n_days")).alias("mean_cum"), "n_days")


def relative_volume(bars: DataFrame, curve: DataFrame, session: str, minute: str, date: str) -> DataFrame:
    """bars with rvol: the session's volume so far over the curve's; null where nothing is expected."""
    w = Window.partitionBy("symbol", session, date).orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    seen = bars.withColumn("cum_vol", F.sum("vol_qu").over(w))
    return seen.join(curve.select("symbol", session, minute, "mean_cum"), ["symbol", session, minute], "left").withColumn("rvol", F.when(F.col("mean_cum") > 0, F.col("cum_vol") / F.col("mean_cum")))


def realized_vol(bars: DataFrame, window: int, time: str = "day") -> DataFrame:
    """bars with vol: the sample deviation of the last `window` log returns, if max(3, window div 3) are known."""
    w = Window.partitionBy("symbol").orderBy(time)
    r = log_return(F.col("close_u"), F.lag("close_u").over(w))
    frame = w.rowsBetween(-(window - 1), 0)
    return bars.withColumn("__r", r).withColumn("realized_vol", F.when(F.count("__r").over(frame) >= max(3, window // 3), F.stddev_samp("__r").over(frame))).drop("__r")


def quadratic_derivatives(bars: DataFrame, window: int, time: str = "day") -> DataFrame:
    """bars with velocity and acceleration at the end of a quadratic fitted to the last window + 1 closes, as weights of
    the closes; null at the beginning."""
    import numpy as np

    x = np.arange(-window, 1, dtype=float)
    fit = np.linalg.pinv(np.vander(x, 3, increasing=True))
    w = Window.partitionBy("symbol").orderBy(time)
    closes = [F.lag("close_u", window - k).over(w).cast("double") for k in range(window + 1)]
    known = F.lag("close_u", window).over(w).isNotNull()
    total = lambda weights: sum((c * float(a) for c, a in zip(closes, weights, strict=True)), F.lit(0.0))
    return bars.withColumn("velocity", F.when(known, total(fit[1]))).withColumn("acceleration", F.when(known, total(2 * fit[2])))


def former_runners(bars: DataFrame, lookback_days: int, move: float, time: str = "day") -> DataFrame:
    """(symbol, n_moves, last_day): bars of the last lookback_days before the newest whose high is `move` above, or low
    `move` below, the open."""
    newest = bars.agg(F.max(time).alias("__newest"))
    moved = (F.col("high_u") >= F.col("open_u") * (1 + move)) | (F.col("low_u") <= F.col("open_u") * (1 - move))
    return bars.crossJoin(F.broadcast(newest)).where((F.datediff("__newest", time) <= lookback_days) & moved).groupBy("symbol").agg(F.count("*").alias("n_moves"), F.max(time).alias("last_day"))


def split_dates(bars: DataFrame, threshold: float, time: str = "day") -> DataFrame:
    """Bars whose open over the close before is at least threshold, or at most 1 / threshold."""
    prev = F.lag("close_u").over(Window.partitionBy("symbol").orderBy(time))
    out = bars.withColumn("ratio", ratio(F.col("open_u"), prev))
    return out.where((F.col("ratio") >= threshold) | (F.col("ratio") <= 1 / threshold))
