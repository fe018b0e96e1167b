"""Order books, costs and markouts, in exact micro units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import ratio
from tidemark.operators.temporal import asof_join

MICRO = 1_000_000
LEVEL = "array<struct<price_u: bigint, qty_u: bigint>>"


def parse_depth(depth_json: Column) -> Column:
    """Struct of bids (descending) and asks (ascending) with positive price and size; unreadable JSON gives empty sides."""
    book = F.from_json(depth_json, f"bids {LEVEL}, asks {LEVEL}")
    good = lambda side: F.filter(F.coalesce(book[side], F.array().cast(LEVEL)), lambda x: (x["price_u"] > 0) & (x["qty_u"] > 0))
    return F.struct(F.sort_array(good("bids"), asc=False).alias("bids"), F.sort_array(good("asks")).alias("asks"))


def mid(bids: Column, asks: Column) -> Column:
    """The mid of a book that isn't crossed; else null."""
    b, a = F.get(bids, F.lit(0))["price_u"], F.get(asks, F.lit(0))["price_u"]
    return F.when(a >= b, (a + b) / 2)


def relative_spread(bid_u: Column, ask_u: Column) -> Column:
    """(ask - bid) / mid; null for a missing or crossed side."""
    return F.when((bid_u > 0) & (ask_u >= bid_u), (ask_u - bid_u) / ((ask_u + bid_u) / 2))


def walk_book(levels: Column, notional_usd: float, max_levels: int = 10) -> Column:
    """What `notional_usd` takes from the levels, best first: struct (spent_u, shares_qu, levels_used, exhausted, avg_px_u).

    A level's value and the shares bought there are floored to micro units; levels worth nothing are skipped; what
    can't be filled isn't priced."""
    target = round(notional_usd * MICRO)

    def step(acc: Column, x: Column) -> Column:
        wide = lambda v: v.cast("decimal(19,0)")
        worth = F.call_function("div", wide(x["price_u"]) * wide(x["qty_u"]), wide(F.lit(MICRO)))
        take = F.least(worth, F.lit(target) - acc["spent_u"])
        shares = F.call_function("div", wide(take) * wide(F.lit(MICRO)), wide(x["price_u"]))
        return F.when(take <= 0, acc).otherwise(
            F.struct((acc["spent_u"] + take).alias("spent_u"), (acc["shares_qu"] + shares).alias("shares_qu"), (acc["levels_used"] + 1).alias("levels_used"))
        )

    zero = F.struct(F.lit(0).cast("long").alias("spent_u"), F.lit(0).cast("long").alias("shares_qu"), F.lit(0).alias("levels_used"))

    def finish(acc: Column) -> Column:
        average = F.when(acc["shares_qu"] > 0, acc["spent_u"] * F.lit(float(MICRO)) / acc["shares_qu"])
        return F.struct(acc["spent_u"], acc["shares_qu"], acc["levels_used"], ((acc["spent_u"] < target) | (acc["shares_qu"] <= 0)).alias("exhausted"), average.alias("avg_px_u"))

    return F.aggregate(F.slice(levels, 1, max_levels), zero, step, finish)


def round_trip_cost(books: DataFrame, notional_usd: float, commission: float = 0.0, max_levels: int = 10) -> DataFrame:
    """books (bids, asks) with entry, exit and total cost as shares of the mid, for buying into the asks and selling into
    the bids; null for crossed or empty books."""
    out = books.withColumn("__m", mid(F.col("bids"), F.col("asks"))).withColumn("__in", walk_book(F.col("asks"), notional_usd, max_levels)).withColumn("__out", walk_book(F.col("bids"), notional_usd, max_levels))
    entry, leave = ratio(F.col("__in.avg_px_u") - F.col("__m"), F.col("__m")), ratio(F.col("__m") - F.col("__out.avg_px_u"), F.col("__m"))
    out = out.withColumns({"entry_cost": entry, "exit_cost": leave, "exhausted": F.col("__in.exhausted") | F.col("__out.exhausted")})
    return out.withColumn("total_cost", F.col("entry_cost") + F.col("exit_cost") + F.lit(commission)).drop("__m", "__in", "__out")


def effective_spread(price_u: Column, mid_u: Column) -> Column:
    return F.when(mid_u > 0, 2 * F.abs(price_u - mid_u) / mid_u)


def align_trades(trades: DataFrame, quotes: DataFrame, max_gap_ms: int, horizon_ms: int) -> DataFrame:
    """trades with the quote before them (within max_gap_ms), its mid, effective_spread, side, and the markout in bp at the
    first quote horizon_ms later or after, signed by the side (null unless the mid is positive)."""
    near = asof_join(trades, quotes, "symbol", "ts_ms", ["mid_u"], tolerance_ms=max_gap_ms, tie="event_id")
    near = near.withColumnRenamed("right_ts_ms", "quote_ms").withColumn("later_ms", F.col("ts_ms") + horizon_ms)
    ahead = quotes.select("symbol", "event_id", F.col("ts_ms").alias("later_ms"), F.col("mid_u").alias("later_mid_u"))
    out = asof_join(near, ahead, "symbol", "later_ms", ["later_mid_u"], forward=True, tie="event_id").drop("right_later_ms", "later_ms")
    side = F.signum((F.col("price_u") - F.col("mid_u")).cast("double")).cast("int")
    return out.withColumn("side", side).withColumn("effective_spread", effective_spread(F.col("price_u"), F.col("mid_u"))).withColumn("markout_bp", side * ratio(F.col("later_mid_u") - F.col("mid_u"), F.col("mid_u")) * 1e4)


def simulate_exits(path: DataFrame, entries: DataFrame, *, horizon_ms: int, target: float | None = None, stop: float | None = None, trail: float | None = None, time_ms: int | None = None) -> DataFrame:
    """entries (entry_id, symbol, entry_ms, entry_u) with exit_u, exit_ms and reason over the bars of path from the entry to
    the horizon.

    In a bar the stop counts before the trail, the trail before the target, and that before the time; the trail's peak
    is that of the bars before. Without a hit the last close counts (horizon); without bars: no_path."""
    from tidemark.operators.temporal import range_pairs

    asked = entries.withColumnRenamed("entry_ms", "ts_ms")
    bars = range_pairs(asked, path.select("symbol", "ts_ms", "high_u", "low_u", "close_u"), "symbol", "ts_ms", -1, horizon_ms)
    w = Window.partitionBy("entry_id").orderBy("r_ts_ms")
    peak = F.greatest(F.col("entry_u"), F.coalesce(F.max("r_high_u").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("entry_u")))
    bars = bars.withColumn("__peak", peak)
    never = F.lit(False)
    stop_u, target_u, trail_u = F.col("entry_u") * (1 - (stop or 0)), F.col("entry_u") * (1 + (target or 0)), F.col("__peak") * (1 - (trail or 0))
    tests = {
        "stop": (F.col("r_low_u") <= stop_u if stop is not None else never, stop_u),
        "trail": ((F.col("r_low_u") <= trail_u) & (F.col("__peak") > F.col("entry_u")) if trail is not None else never, trail_u),
        "target": (F.col("r_high_u") >= target_u if target is not None else never, target_u),
        "time": (F.col("r_ts_ms") >= F.col("ts_ms") + time_ms if time_ms is not None else never, F.col("r_close_u").cast("double")),
    }
    reason, price = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (hit, at) in reversed(tests.items()):
        reason, price = F.when(hit, name).otherwise(reason), F.when(hit, at).otherwise(price)
    hits = bars.withColumn("reason", reason).withColumn("px", price)
    ended = hits.groupBy("entry_id").agg(
        F.min(F.when(F.col("reason").isNotNull(), F.struct("r_ts_ms", "reason", "px"))).alias("hit"), F.max(F.struct("r_ts_ms", F.col("r_close_u").cast("double").alias("px"))).alias("last")
    )
    out = entries.join(ended, "entry_id", "left")
    pick = lambda a, b: F.coalesce(F.col(a), F.col(b))
    return out.select(
        *entries.columns,
        pick("hit.px", "last.px").alias("exit_u"),
        pick("hit.r_ts_ms", "last.r_ts_ms").alias("exit_ms"),
        F.coalesce("hit.reason", F.when(F.col("last").isNotNull(), "horizon").otherwise("no_path")).alias("reason"),
    )
