"""Distributions, two-scale means and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import exact_quantiles


#: Names of a distribution's quantiles.
QUANTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def distribution(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, p10, p25, median, p75, p90): counts, means and exact quantiles of a column; nulls don't count."""
    cuts = exact_quantiles(df, [group], value, tuple(QUANTILES.values()))
    named = cuts.groupBy(group).agg(*[F.max(F.when(F.abs(F.col("quantile") - q) < 1e-9, F.col("value"))).alias(n) for n, q in QUANTILES.items()])
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).join(named, group, "left")


def two_scales(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the mean over rows, and the mean of the groups' means."""
    per = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return per.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("row_mean"), F.avg(F.try_divide("s", "n")).alias("group_mean"), F.count("*").alias("n_groups"))


def concentration(df: DataFrame, group: str, tops: tuple[int, ...]) -> DataFrame:
    """One row: the share of rows in the largest groups (ties to the smaller group). Only the largest are put in order."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    largest = counts.orderBy(F.desc("n"), group).limit(max(tops)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), group)))  # as many rows as the largest top
    sums = largest.agg(*[F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("n"))), F.lit(0)).alias(f"top{k}") for k in tops])
    return sums.crossJoin(F.broadcast(df.agg(F.count("*").alias("n")))).select(*[F.try_divide(f"top{k}", "n").alias(f"top{k}_share") for k in tops])  # one row each


def weighted_quantile(df: DataFrame, group: str, value: str, weight: str, quantiles: tuple[float, ...]) -> DataFrame:
    """(group, quantile, value): the least value at which the running weight reaches the share; no interpolation. Equal
    values are put together before they are ordered."""
    per = df.where(F.col(weight) > 0).groupBy(group, F.col(value).alias("value")).agg(F.sum(weight).alias("w"))
    run = Window.partitionBy(group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cum = per.withColumn("c", F.sum("w").over(run)).withColumn("t", F.sum("w").over(Window.partitionBy(group)))
    wanted = cum.withColumn("quantile", F.explode(F.array(*map(F.lit, quantiles))))
    return wanted.where(F.col("c") >= F.col("quantile") * F.col("t")).groupBy(group, "quantile").agg(F.min("value").alias("value"))


def mean_rank(partition: list[str], value: str) -> Column:
    """Ranks with ties at their mean."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, n, rho): rank correlation with mean ranks over rows that have both; null if either is constant."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, mean_rank([group], x).alias("rx"), mean_rank([group], y).alias("ry"))
    out = ranked.groupBy(group).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"), F.min("rx").alias("a"), F.max("rx").alias("b"), F.min("ry").alias("c"), F.max("ry").alias("d"))
    return out.select(group, "n", F.when((F.col("a") < F.col("b")) & (F.col("c") < F.col("d")), F.col("rho")).alias("rho"))


def bucketed(df: DataFrame, value: str, buckets: int, name: str = "bucket") -> DataFrame:
    """df with the number, from 0, of the value's quantile bucket: edges are exact quantiles, intervals closed on the
    right, equal edges merged. The edges are one small row, joined by broadcast."""
    cuts = exact_quantiles(df, [], value, tuple(k / buckets for k in range(buckets + 1)))
    edges = cuts.agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("quantile", "value"))), lambda x: x["value"])).alias("__e"))
    inner = F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0)))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(value))))).drop("__e")


def lag_correlation(panel: DataFrame, x: str, y: str, lags: tuple[int, ...], step: int, time: str = "start_ms") -> DataFrame:
    """(lag, n, corr) of x at t and y at t + lag steps, of one symbol."""
    shifted = panel.select("symbol", F.col(time), F.col(y).alias("__y"))
    wanted = panel.select("symbol", time, F.col(x).alias("__x")).withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn(time, F.col(time) + F.col("lag") * step)
    return wanted.join(shifted, ["symbol", time]).where("__x is not null and __y is not null").groupBy("lag").agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("corr"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share."""
    p, zz = F.try_divide(hits, n), z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, centre - half), F.when(n > 0, centre + half)
