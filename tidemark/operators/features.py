"""Features, research tables and matched pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.temporal import forward, trailing


def micro(text: Column) -> Column:
    """Micro units of a decimal text, half to even; null for text that isn't a number."""
    return F.bround(text.try_cast("decimal(24,12)") * 1_000_000, 0).cast("long")


def weighted_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """The weighted sum of parts in [0, 1], held to [0, 1]; a null part counts as 0."""
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def imbalance(bids: Column, asks: Column) -> Column:
    """(bid - ask) / (bid + ask) over the sizes of all levels; null for an empty book."""
    size = lambda side: F.aggregate(side, F.lit(0).cast("long"), lambda acc, x: acc + x["qty_u"])
    return F.try_divide((size(bids) - size(asks)).cast("double"), (size(bids) + size(asks)).cast("double"))


def forward_probe(bars: DataFrame, span_ms: int) -> DataFrame:
    """bars with what follows in (t, t + span]: n_ahead, max_high_u, its first time, and the last close."""
    w = forward("symbol", "ts_ms", span_ms)
    first_max = F.min(F.struct((-F.col("high_u")).alias("h"), F.col("ts_ms").alias("t"))).over(w)
    return bars.withColumns({"n_ahead": F.count("*").over(w), "__m": first_max, "end_u": F.last("close_u").over(w)}).select("*", (-F.col("__m.h")).alias("max_high_u"), F.col("__m.t").alias("max_ms")).drop("__m")


def first_z_cross(grid: DataFrame, volume: str, rows: int, threshold: float) -> DataFrame:
    """(symbol, cross_ms): the first step of a dense grid whose log1p volume lies `threshold` deviations above the mean of
    the `rows` steps before, when all of them are there."""
    w = Window.partitionBy("symbol").orderBy("ts_ms").rowsBetween(-rows, -1)
    x = grid.withColumn("__x", F.log1p(F.col(volume)))
    z = F.when((F.count("*").over(w) >= rows) & (F.stddev_samp("__x").over(w) > 0), (F.col("__x") - F.avg("__x").over(w)) / F.stddev_samp("__x").over(w))
    return x.withColumn("__z", z).where(F.col("__z") >= threshold).groupBy("symbol").agg(F.min("ts_ms").alias("cross_ms"))


def oversold_entries(series: DataFrame, drop: float, lookback_ms: int) -> DataFrame:
    """(symbol, entry_ms, price_u): the first row at or below the trailing maximum less `drop` and above the row before."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", "event_id")
    top = F.max("price_u").over(trailing("symbol", "ts_ms", lookback_ms))
    found = series.withColumn("__m", top).withColumn("__p", F.lag("price_u").over(w)).where((F.col("price_u") <= F.col("__m") * (1 - drop)) & (F.col("price_u") > F.col("__p")))
    return found.groupBy("symbol").agg(F.min(F.struct("ts_ms", "event_id", "price_u")).alias("e")).select("symbol", F.col("e.ts_ms").alias("entry_ms"), F.col("e.price_u").alias("price_u"))


def print_gap_ratio(prints: DataFrame, recent: int, baseline: int) -> DataFrame:
    """(symbol, ratio): the median gap of the last `recent` prints over that of the `baseline` gaps before; null without
    enough prints."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", "event_id")
    back = Window.partitionBy("symbol").orderBy(F.desc("ts_ms"), F.desc("event_id"))
    gaps = prints.withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(w)).withColumn("k", F.row_number().over(back)).where("gap is not null")
    late, early = F.when(F.col("k") <= recent, F.col("gap")), F.when((F.col("k") > recent) & (F.col("k") <= recent + baseline), F.col("gap"))
    out = gaps.groupBy("symbol").agg(F.percentile(late, 0.5).alias("a"), F.percentile(early, 0.5).alias("b"), F.count(early).alias("n"))
    return out.select("symbol", F.when((F.col("n") >= baseline) & (F.col("b") > 0), F.col("a") / F.col("b")).alias("ratio"))


def confusion(df: DataFrame, signal: str, truth: str, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, precision, recall, f1) of signal >= threshold against a boolean truth."""
    wanted = df.where(F.col(signal).isNotNull()).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit = F.col(signal) >= F.col("threshold")
    out = wanted.groupBy("threshold").agg(F.count_if(hit & F.col(truth)).alias("tp"), F.count_if(hit & ~F.col(truth)).alias("fp"), F.count_if(~hit & F.col(truth)).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def within_period_spread(panel: DataFrame, period: str, signal: str, outcome: str, share: float) -> DataFrame:
    """One row: mean outcome of the top and of the bottom share by signal within each period (ties by symbol), and their
    difference."""
    w = Window.partitionBy(period).orderBy(signal, "symbol")
    placed = panel.where(F.col(signal).isNotNull() & F.col(outcome).isNotNull()).withColumn("p", F.row_number().over(w) / F.count("*").over(Window.partitionBy(period)))
    top, low = F.avg(F.when(F.col("p") > 1 - share, F.col(outcome))), F.avg(F.when(F.col("p") <= share, F.col(outcome)))
    return placed.agg(top.alias("top_mean"), low.alias("bottom_mean"), (top - low).alias("spread"))


def pool_sizes(events: DataFrame, bars: DataFrame, key: str, tolerance: float, gap_ms: int) -> DataFrame:
    """events (event_id, symbol, ts_ms, key) with n_pool: bars of the symbol whose key lies within a factor of 1 + tolerance
    and which are more than gap_ms away.

    Keys are put into bands of the logarithm as wide as the tolerance, and bands are joined with their neighbours, so an
    event meets only bars of nearly its key."""
    import math

    width = math.log1p(tolerance)
    band = lambda c: F.floor(F.log(F.col(c)) / width)
    pool = bars.where(F.col(key) > 0).select("symbol", F.col("ts_ms").alias("__t"), F.col(key).alias("__v"), band(key).alias("__b"))
    asked = events.withColumn("__b", F.explode(F.sequence(band(key) - 1, band(key) + 1)))
    near = F.abs(F.log(F.col("__v") / F.col(key))) <= width
    found = asked.join(pool, ["symbol", "__b"]).where(near & (F.abs(F.col("__t") - F.col("ts_ms")) > gap_ms)).groupBy("event_id").agg(F.count("*").alias("n_pool"))
    return events.join(found, "event_id", "left").withColumn("n_pool", F.coalesce("n_pool", F.lit(0)))


def contrast(df: DataFrame, group: str, value: str, left: Column, right: Column, least: int) -> DataFrame:
    """(group, left, right, delta) medians of two strata of each group that has `least` rows in both."""
    a, b = F.when(left, F.col(value)), F.when(right, F.col(value))
    out = df.groupBy(group).agg(F.percentile(a, 0.5).alias("left"), F.percentile(b, 0.5).alias("right"), F.count(a).alias("na"), F.count(b).alias("nb"))
    return out.where((F.col("na") >= least) & (F.col("nb") >= least)).select(group, "left", "right", (F.col("left") - F.col("right")).alias("delta"))


def report(title: str, sections: dict[str, DataFrame], rows: int = 50) -> str:
    """A Markdown report; each section shows at most `rows` rows of its table, and says so if a table can't be read."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out.append(f"\n## {name}\n")
        try:
            shown = df.limit(rows).collect()
        except Exception as e:  # a missing table costs its section, not the report
            out.append(f"not available: {type(e).__name__}")
            continue
        out += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in shown)]
    return "\n".join(out) + "\n"
