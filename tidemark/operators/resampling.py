"""Cluster bootstraps over mergeable sums: means, differences of arms, and regressions within groups.

Rows are reduced to sums of their cluster in one pass; what a draw uses of a cluster is a Poisson(1) number made from a hash of
cluster, draw and seed, so all draws are one aggregate over clusters times draws, nothing is collected, and the same seed gives
the same draws anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cumulative Poisson(1) probabilities of no use to five uses (fixed values).
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


def uses(cluster: Column, draw: Column, seed: int) -> Column:
    """How often a draw uses a cluster: 0 to 6, with Poisson(1) probabilities."""
    digits = F.substring(F.md5(F.concat_ws("-", cluster.cast("string"), draw.cast("string"), F.lit(str(seed)))), 1, 7)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 28)
    return sum((u > p).cast("long") for p in POISSON)


def _resampled(clusters: DataFrame, by: list[str], cluster: str, sums: list[str], draws: int, seed: int) -> DataFrame:
    """(by, draw, sums): weighted sums of each draw."""
    each = clusters.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__k", uses(F.col(cluster), F.col("draw"), seed))
    return each.where("__k > 0").groupBy(*by, "draw").agg(*[F.sum(F.col("__k") * F.col(c)).alias(c) for c in sums])


def _intervals(points: DataFrame, drawn: DataFrame, by: list[str], value: str, comparisons: int, min_clusters: int) -> DataFrame:
    """points with 95 % and Bonferroni intervals of the draws, and whether they hold zero; null with too few clusters."""
    alpha = 0.05 / max(1, comparisons)
    cuts = {"ci_low": 0.025, "ci_high": 0.975, "bonferroni_low": alpha / 2, "bonferroni_high": 1 - alpha / 2}
    ci = drawn.groupBy(*by).agg(*[F.percentile(value, q).alias(n) for n, q in cuts.items()])
    both = points.join(ci, by, "left") if by else points.crossJoin(F.broadcast(ci))  # without by each is one row
    enough = F.col("n_clusters") >= min_clusters
    out = both.withColumns({n: F.when(enough, F.col(n)) for n in cuts})
    return out.withColumns({f"{n}_holds_zero": (F.col(f"{n}_low") <= 0) & (F.col(f"{n}_high") >= 0) for n in ("ci", "bonferroni")})


def bootstrap_mean(df: DataFrame, by: list[str], cluster: str, value: str, draws: int, seed: int, comparisons: int = 1, min_clusters: int = 2) -> DataFrame:
    """(by, mean, n, n_clusters, intervals): the mean of rows when clusters are drawn with replacement.

    Nulls and NaN don't count. With fewer than min_clusters clusters there is a mean and no interval."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    per = known.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    points = per.groupBy(*by).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"), F.sum("n").alias("n"), F.count("*").alias("n_clusters"))
    drawn = _resampled(per, by, cluster, ["s", "n"], draws, seed).withColumn("m", F.try_divide("s", "n"))
    return _intervals(points, drawn, by, "m", comparisons, min_clusters)


def bootstrap_difference(df: DataFrame, by: list[str], cluster: str, first: Column, value: str, draws: int, seed: int, comparisons: int = 1, min_clusters: int = 2) -> DataFrame:
    """(by, n_first, n_second, mean_first, mean_second, mean_diff, n_clusters, intervals): the difference of two arms' means.

    first tells the rows of the first arm. Clusters that lack one of the arms are left out, as their arms aren't comparable."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    v = F.col(value)
    per = known.groupBy(*by, cluster).agg(
        F.coalesce(F.sum(F.when(first, v)), F.lit(0.0)).alias("s1"), F.count_if(first).alias("n1"), F.coalesce(F.sum(F.when(~first, v)), F.lit(0.0)).alias("s2"), F.count_if(~first).alias("n2")
    ).where("n1 > 0 and n2 > 0")
    means = {"mean_first": F.try_divide(F.sum("s1"), F.sum("n1")), "mean_second": F.try_divide(F.sum("s2"), F.sum("n2"))}
    points = per.groupBy(*by).agg(F.sum("n1").alias("n_first"), F.sum("n2").alias("n_second"), *[m.alias(n) for n, m in means.items()], F.count("*").alias("n_clusters"))
    points = points.withColumn("mean_diff", F.col("mean_first") - F.col("mean_second"))
    drawn = _resampled(per, by, cluster, ["s1", "n1", "s2", "n2"], draws, seed).withColumn("d", F.try_divide("s1", "n1") - F.try_divide("s2", "n2"))
    return _intervals(points, drawn, by, "d", comparisons, min_clusters)


_SUMS = ["g", "sxx", "sxz", "szz", "sxy", "szy", "dx", "dz", "dy"]


def _effect() -> dict[str, Column]:
    """beta_x, beta_z, rank and estimate from sums of groups: the least-squares solution of least norm."""
    a, b, c, p, q = (F.col(n) for n in ("sxx", "sxz", "szz", "sxy", "szy"))
    det, trace = a * c - b * b, a + c
    full, some = det > 1e-12 * trace * trace, trace > 0
    beta_x = F.when(full, (c * p - b * q) / det).when(some, (a * p + b * q) / (trace * trace)).otherwise(0.0)
    beta_z = F.when(full, (a * q - b * p) / det).when(some, (b * p + c * q) / (trace * trace)).otherwise(0.0)
    return {"beta_x": beta_x, "beta_z": beta_z, "rank": F.when(full, 2).when(some, 1).otherwise(0), "estimate": F.try_divide(F.col("dy") - F.col("dx") * beta_x - F.col("dz") * beta_z, F.col("g"))}


def within_group_regression(
    events: DataFrame, controls: DataFrame, by: list[str], group: str, cluster: str, x: str, z: str, y: str, draws: int, seed: int, comparisons: int = 1, min_clusters: int = 2
) -> DataFrame:
    """(by, n_events, n_clusters, beta_x, beta_z, rank, estimate, intervals): how far events lie from what their own controls
    predict, with slopes in x and z that all groups share.

    events has one row for each group, with its cluster; controls have any number. A group's controls give sums of products
    around their means, over their number, so that groups weigh alike; the slopes solve the sums of all groups. An event's
    effect is its y less its controls' mean, moved along the slopes to its own x and z. Effects are linear in the slopes, so a
    draw needs only nine sums of each cluster. Rows that lack x, z or y, and groups without an event or controls, don't count."""
    def complete(d: DataFrame) -> DataFrame:
        for c in (x, z, y):
            d = d.where(F.col(c).isNotNull() & ~F.isnan(c))
        return d

    mean = lambda c: F.avg(c)
    of = complete(controls).groupBy(*by, group).agg(
        mean(x).alias("mx"), mean(z).alias("mz"), mean(y).alias("my"), F.covar_pop(x, x).alias("sxx"), F.covar_pop(x, z).alias("sxz"), F.covar_pop(z, z).alias("szz"), F.covar_pop(x, y).alias("sxy"), F.covar_pop(z, y).alias("szy")
    )
    each = complete(events).join(of, [*by, group]).withColumns({"g": F.lit(1), "dx": F.col(x) - F.col("mx"), "dz": F.col(z) - F.col("mz"), "dy": F.col(y) - F.col("my")})
    per = each.groupBy(*by, cluster).agg(*[F.sum(c).alias(c) for c in _SUMS])
    whole = per.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS], F.count("*").alias("n_clusters")).withColumns(_effect())
    points = whole.select(*by, F.col("g").alias("n_events"), "n_clusters", "beta_x", "beta_z", "rank", "estimate")
    drawn = _resampled(per, by, cluster, _SUMS, draws, seed).withColumns(_effect()).withColumnRenamed("estimate", "e")
    return _intervals(points, drawn, by, "e", comparisons, min_clusters)
