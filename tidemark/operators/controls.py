"""Matched controls: pools of bars like an event's, draws from them by hash, outcomes of both arms, and what they differ by."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import ratio


def shuffled(key: Column, seed: int) -> Column:
    """A fixed order that has nothing to do with the rows' values: the hash of a key and a seed."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(seed)))


def draw_controls(events: DataFrame, bars: DataFrame, value: str, tolerances: tuple[float, ...], gap_ms: int, draws: int, seed: int = 0) -> DataFrame:
    """(event_id, tolerance, draw, symbol, control_ms, n_pool): up to `draws` control bars for each event (event_id, symbol,
    ts_ms, value) and tolerance.

    A pool holds the bars (symbol, ts_ms, value) of the symbol whose value lies within a factor of 1 + tolerance and
    which are more than gap_ms away; its bars are drawn in hashed order, without repeats. Values are put into bands as
    wide as the widest tolerance, so that an event meets only bars of nearly its value."""
    width = math.log1p(max(tolerances)) * (1 + 1e-9)  # a pair just at the tolerance mustn't fall two bands apart by rounding
    band = lambda c: F.floor(F.log(F.col(c)) / width)
    pool = bars.where(F.col(value) > 0).select("symbol", F.col("ts_ms").alias("control_ms"), F.col(value).alias("__v"), band(value).alias("__b"))
    asked = events.where(F.col(value) > 0).withColumn("__b", F.explode(F.sequence(band(value) - 1, band(value) + 1)))
    low, high = F.least("__v", value).cast("double"), F.greatest("__v", value).cast("double")
    near = asked.join(pool, ["symbol", "__b"]).where((high <= low * (1 + max(tolerances))) & (F.abs(F.col("control_ms") - F.col("ts_ms")) > gap_ms))
    each = near.withColumn("tolerance", F.explode(F.array(*map(F.lit, tolerances)))).where(high <= low * (1 + F.col("tolerance")))
    of = Window.partitionBy("event_id", "tolerance")
    order = shuffled(F.concat_ws("-", F.col("event_id").cast("string"), F.col("control_ms").cast("string")), seed)
    drawn = each.withColumns({"n_pool": F.count("*").over(of), "draw": F.row_number().over(of.orderBy(order, "control_ms"))})
    return drawn.where(F.col("draw") <= draws).select("event_id", "tolerance", "draw", "symbol", "control_ms", "n_pool")


def arms(events: DataFrame, controls: DataFrame) -> DataFrame:
    """(event_id, tolerance, arm, draw, symbol, ts_ms): events that have controls, once for each tolerance, beside them."""
    real = events.join(controls.select("event_id", "tolerance").distinct(), "event_id").select("event_id", "tolerance", F.lit("real").alias("arm"), F.lit(0).alias("draw"), "symbol", "ts_ms")
    return real.unionByName(controls.select("event_id", "tolerance", F.lit("control").alias("arm"), "draw", "symbol", F.col("control_ms").alias("ts_ms")))


def forward_outcomes(anchors: DataFrame, bars: DataFrame, span_ms: int) -> DataFrame:
    """anchors (symbol, ts_ms) with the bar in force, and its return to the last, and to the highest, price of the bars in
    (ts, ts + span]; null without one. Bars know their own future by windows; anchors meet them by an as-of join."""
    from tidemark.operators.temporal import asof_join

    w = Window.partitionBy("symbol").orderBy("ts_ms").rangeBetween(1, span_ms)
    known = bars.select("symbol", "ts_ms", "close_u", (ratio(F.last("close_u").over(w), F.col("close_u")) - 1).alias("ret_end"), (ratio(F.max("high_u").over(w), F.col("close_u")) - 1).alias("ret_max"))
    return asof_join(anchors, known, "symbol", "ts_ms", ["close_u", "ret_end", "ret_max"]).withColumnRenamed("right_ts_ms", "bar_ms")


def paired_differences(outcomes: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n_pairs, real_mean, control_mean, mean_diff, sd_diff, low, high) of rows (by, event_id, arm, value).

    An event's controls are averaged first; pairs without a value on either side are left out; the interval is normal."""
    per = outcomes.groupBy(*by, "event_id").agg(F.avg(F.when(F.col("arm") == "real", F.col(value))).alias("a"), F.avg(F.when(F.col("arm") == "control", F.col(value))).alias("b"))
    both = per.where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    out = both.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("a").alias("real_mean"), F.avg("b").alias("control_mean"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"))
    half = 1.96 * F.col("sd_diff") / F.sqrt("n_pairs")
    return out.withColumns({"low": F.col("mean_diff") - half, "high": F.col("mean_diff") + half})


def balance(outcomes: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column, real_mean, control_mean, std_diff): means of both arms, and their difference over the pooled deviation."""
    long = outcomes.select(*by, "arm", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])))
    at = lambda f, arm: f(F.when(F.col("arm") == arm, F.col("x")))
    out = long.groupBy(*by, "column").agg(at(F.avg, "real").alias("real_mean"), at(F.avg, "control").alias("control_mean"), at(F.var_samp, "real").alias("a"), at(F.var_samp, "control").alias("b"))
    return out.withColumn("std_diff", ratio(F.col("real_mean") - F.col("control_mean"), F.sqrt((F.col("a") + F.col("b")) / 2))).drop("a", "b")


def verdict(b: str, b_low: str, b_high: str, c: str, c_low: str, c_high: str, line: float) -> Column:
    """Which of five cells two estimates with intervals fall into: b may be quoted only where c agrees with it."""
    clears, other = F.coalesce(F.col(b_low) > line, F.lit(False)), F.coalesce(F.col(c_low) > line, F.lit(False))
    agrees = F.coalesce((F.col(b) > 0) & (F.col(c) > 0) & F.col(c).between(F.col(b_low), F.col(b_high)) & F.col(b).between(F.col(c_low), F.col(c_high)), F.lit(False))
    smaller = F.coalesce((F.col(c) <= 0) | ((F.col(c) < F.col(b)) & ~agrees), F.lit(False))
    return F.when(clears & agrees, "clears_agrees").when(clears & smaller, "clears_killed").when(clears, "clears_disagrees").when(other, "misses_finding_only").otherwise("both_miss")


def days_needed(sd: Column, half_width: float, per_day: Column, least: int = 30, z: float = 1.96) -> Column:
    """How many days of data give a mean an interval of +- half_width; null for inputs that aren't positive."""
    n = F.greatest(F.lit(float(least)), F.pow(z * sd / half_width, F.lit(2.0)))
    return F.when((sd > 0) & (per_day > 0), F.ceil(n / per_day))
