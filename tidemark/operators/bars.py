"""Bars, tumbling windows and tape classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000


def ratio(a: Column, b: Column) -> Column:
    """a / b; null unless the divisor is positive, as prices and amounts must be."""
    return F.when(b > 0, a / b)


def float_ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite, or NaN for 0 / 0, where the divisor is zero; null without either."""
    over_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def log_return(last_u: Column, first_u: Column) -> Column:
    """ln(last / first); null unless both prices are positive."""
    return F.when((last_u > 0) & (first_u > 0), F.log(last_u / first_u))


def time_bars(ticks: DataFrame, width_ms: int, order: list[str]) -> DataFrame:
    """Bars labelled by their end: (symbol, ts_ms, open_u, high_u, low_u, close_u, vol_qu, n, notional_u, vwap_u).

    order names the columns that put prints of one time in order. VWAP is the floor of the exact ratio."""
    at = F.struct("ts_ms", *order)
    label = ((F.floor(F.col("ts_ms") / width_ms) + 1) * width_ms).cast("long")
    exact = F.col("price_u").cast("decimal(19,0)") * F.col("qty_u").cast("decimal(19,0)")
    out = ticks.groupBy("symbol", label.alias("bar_ms")).agg(
        F.min_by("price_u", at).alias("open_u"),
        F.max("price_u").alias("high_u"),
        F.min("price_u").alias("low_u"),
        F.max_by("price_u", at).alias("close_u"),
        F.sum("qty_u").alias("vol_qu"),
        F.count("*").alias("n"),
        F.sum(exact).alias("__pq"),
    )
    return out.withColumn("notional_u", F.expr(f"cast(__pq div {MICRO} as bigint)")).withColumn("vwap_u", F.expr("cast(case when vol_qu > 0 then __pq div vol_qu end as bigint)")).drop("__pq").withColumnRenamed("bar_ms", "ts_ms")


def tick_rule(ticks: DataFrame, order: list[str]) -> DataFrame:
    """ticks with side: the sign of the last price change of the symbol up to the print, 0 before the first change."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", *order)
    sign = F.signum((F.col("price_u") - F.lag("price_u").over(w)).cast("double")).cast("int")
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumn("__s", F.when(sign != 0, sign)).withColumn("side", F.coalesce(F.last("__s", ignorenulls=True).over(frame), F.lit(0))).drop("__s")


def flow_windows(ticks: DataFrame, width_ms: int, order: list[str]) -> DataFrame:
    """Tumbling windows of classified prints (side): counts, imbalance, log return in bp (null
    unless both prices are positive), and the next window's return if it follows without a gap."""
    at = F.struct("ts_ms", *order)
    start = (F.floor(F.col("ts_ms") / width_ms) * width_ms).cast("long")
    out = ticks.groupBy("symbol", start.alias("start_ms")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("side") > 0).alias("buys"),
        F.count_if(F.col("side") < 0).alias("sells"),
        F.min_by("price_u", at).alias("first_u"),
        F.max_by("price_u", at).alias("last_u"),
    )
    out = out.withColumn("imbalance", F.try_divide(F.col("buys") - F.col("sells"), F.col("buys") + F.col("sells")))
    out = out.withColumn("ret_bp", log_return(F.col("last_u"), F.col("first_u")) * 1e4)
    w = Window.partitionBy("symbol").orderBy("start_ms")
    return out.withColumn("next_ret_bp", F.when(F.lead("start_ms").over(w) == F.col("start_ms") + width_ms, F.lead("ret_bp").over(w)))


def quote_rule(price_u, mid_u):
    """1 above the mid, -1 below, 0 at it; null without a mid."""
    return F.signum((price_u - mid_u).cast("double")).cast("int")


def saturation(ticks: DataFrame, width_ms: int, cap: int) -> DataFrame:
    """One row: buckets, the share of buckets with cap prints or more, and the share of prints in those."""
    n = ticks.groupBy("symbol", F.floor(F.col("ts_ms") / width_ms).alias("b")).agg(F.count("*").alias("n"))
    full = F.col("n") >= cap
    return n.agg(F.count("*").alias("n_buckets"), F.avg(full.cast("double")).alias("share_at_cap"), (F.sum(F.when(full, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_of_rows"))
