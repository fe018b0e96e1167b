"""Audits of coverage and cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def time_gaps(df: DataFrame, key: str, time: str, beyond_ms: int) -> DataFrame:
    """(key, gap_from_ms, gap_to_ms, gap_ms): stretches between consecutive times of a key beyond the limit."""
    prev = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    out = df.select(key, time).distinct().withColumn("gap_from_ms", prev).withColumn("gap_ms", F.col(time) - F.col("gap_from_ms"))
    return out.where(F.col("gap_ms") > beyond_ms).select(key, "gap_from_ms", F.col(time).alias("gap_to_ms"), "gap_ms")


def coverage(bars: DataFrame, key: str, time: str, step_ms: int) -> DataFrame:
    """(key, n_bars, n_expected, share): bars over the steps from a key's first to its last."""
    out = bars.groupBy(key).agg(F.countDistinct(time).alias("n_bars"), ((F.max(time) - F.min(time)) / step_ms + 1).cast("long").alias("n_expected"))
    return out.withColumn("share", F.col("n_bars") / F.col("n_expected"))


def cadence(df: DataFrame, time: str, cap_ms: int) -> DataFrame:
    """One row: how many steps between consecutive distinct times, their mean and median up to the cap, and how many lie
    beyond. Times are made distinct, and put in order within days, before the days are joined end to end."""
    times = df.select(F.col(time).alias("t")).distinct().withColumn("d", F.floor(F.col("t") / 86_400_000))
    inner = times.withColumn("p", F.lag("t").over(Window.partitionBy("d").orderBy("t")))
    ends = times.groupBy("d").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    seams = ends.withColumn("p", F.lag("b").over(Window.orderBy("d"))).select(F.col("a").alias("t"), "p")
    gaps = inner.where("p is not null").select("t", "p").union(seams.where("p is not null")).select((F.col("t") - F.col("p")).alias("gap"))
    near = F.when(F.col("gap") <= cap_ms, F.col("gap"))
    return gaps.agg(F.count("*").alias("n_steps"), F.avg(near).alias("mean_ms"), F.percentile(near, 0.5).alias("median_ms"), F.count_if(F.col("gap") > cap_ms).alias("n_beyond"))


def completeness(prints: DataFrame, bars: DataFrame, key: str, time: str, width_ms: int, offsets: tuple[int, ...]) -> DataFrame:
    """(offset, n_print_bars, n_matched): how many of the bars that prints call for are there, at each label offset."""
    wanted = prints.select(key, (F.floor(F.col(time) / width_ms) * width_ms).cast("long").alias("__t")).distinct().withColumn("offset", F.explode(F.array(*map(F.lit, offsets))))
    there = bars.select(key, F.col(time).alias("__t"), F.lit(1).alias("__hit")).distinct()
    joined = wanted.withColumn("__t", F.col("__t") + F.col("offset") * width_ms).join(there, [key, "__t"], "left")
    return joined.groupBy("offset").agg(F.count("*").alias("n_print_bars"), F.count("__hit").alias("n_matched"))
