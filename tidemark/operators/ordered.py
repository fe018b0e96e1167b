"""Orders over whole tables without one task that sorts them: running sums, ranks and exact quantiles by buckets of values.

Rows are dealt into buckets of the order, each bucket is sorted by itself, and only the buckets' totals, a bounded number of rows,
are put in order in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of an order; their totals are what one task sees.
BUCKETS = 256


def running_sums(df: DataFrame, order: str, bucket: Column, sums: dict[str, str], following: str | None = None) -> DataFrame:
    """df with, for each name, the sum of its column over all rows up to this one in ascending order; ties share a sum.

    bucket must ascend with the order, and have a bounded number of values. following: a column for the next larger value of
    the order, null for the last."""
    w = Window.partitionBy("__b").orderBy(order)
    cut = df.withColumn("__b", bucket)
    totals = cut.groupBy("__b").agg(F.min(order).alias("__first"), *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before, after = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("__b")
    totals = totals.select(F.col("__b").alias("__tb"), F.lead("__first").over(after).alias("__next"), *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in sums])
    run = w.rangeBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({f"__i_{n}": F.sum(c).over(run) for n, c in sums.items()})
    if following:
        inside = inside.withColumn("__lead", F.lead(order).over(w))
    out = inside.join(totals, F.col("__b") == F.col("__tb"), "left").withColumns({n: F.col(f"__i_{n}") + F.col(f"__t_{n}") for n in sums})
    if following:
        out = out.withColumn(following, F.coalesce("__lead", "__next"))
    return out.drop("__b", "__tb", "__next", "__lead", *[f"__{x}_{n}" for n in sums for x in "it"])


def _edges(df: DataFrame, value: str, group: list[str], buckets: int) -> DataFrame:
    """(group, __edges): values that part the rows into buckets of about one size, from a sketch."""
    cuts = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    return df.groupBy(*group).agg(F.array_distinct(F.percentile_approx(value, cuts, F.lit(10 * buckets))).alias("__edges"))


def _dealt(df: DataFrame, value: str, group: list[str], buckets: int) -> DataFrame:
    """df with __b, the number of edges below the value; edges are one row a group."""
    edges = _edges(df, value, group, buckets)
    both = df.join(edges, group) if group else df.crossJoin(F.broadcast(edges))  # one row
    return both.withColumn("__b", F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__edges")


def mean_ranks(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """df with the rank of a value, from 1, ties at their mean, over all rows that have one; null without one.

    Equal values are always in one bucket, so a rank is the rows of lower buckets and the rank within its own."""
    known = _dealt(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__c")), value, [], BUCKETS)
    summed = running_sums(known, value, F.col("__b"), {"__upto": "__c"})
    whole = df.agg(F.count(value).alias("__n"))
    first = F.col("__n") - F.col("__upto") if descending else F.col("__upto") - F.col("__c")
    ranks = summed.crossJoin(F.broadcast(whole)).select(F.col(value).alias("__v"), (first + (F.col("__c") + 1) / 2).alias(name))  # one row
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def exact_quantiles(df: DataFrame, group: list[str], value: str, quantiles: tuple[float, ...], buckets: int = 64) -> DataFrame:
    """(group, quantile, value): exact quantiles, interpolated between neighbours; nulls don't count.

    Equal values are counted first. The buckets' totals tell which of them hold a wanted place; only those are sorted, each by
    itself. No aggregate gathers a group's values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    dealt = _dealt(counted, "__v", group, buckets)
    run = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy(*group, "__b").agg(F.sum("__c").alias("__t"))
    if not group:
        run = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)  # one row a bucket
    totals = totals.withColumn("__upto", F.sum("__t").over(run)).withColumn("__before", F.col("__upto") - F.col("__t"))
    n = totals.groupBy(*group).agg(F.sum("__t").alias("__n"))
    place = lambda q: (F.col("__n") - 1) * q
    asked = n.select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile")).withColumn("__at", place(F.col("quantile")))
    asked = asked.select(*group, "quantile", "__at", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__k"))
    both = totals.join(asked, group) if group else totals.crossJoin(F.broadcast(asked))  # two rows a quantile
    wanted = both.where((F.col("__before") <= F.col("__k")) & (F.col("__k") < F.col("__upto"))).select(*group, "__b", "__before", "quantile", "__at", "__k")
    held = dealt.join(wanted.select(*group, "__b", "__before").distinct(), [*group, "__b"])
    sorted_ = held.withColumn("__upto", F.col("__before") + F.sum("__c").over(Window.partitionBy(*group, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = sorted_.drop("__before").join(wanted.drop("__before"), [*group, "__b"]).where((F.col("__k") < F.col("__upto")) & (F.col("__k") >= F.col("__upto") - F.col("__c")))
    share = 1 - F.abs(F.col("__k") - F.col("__at"))
    return hit.groupBy(*group, "quantile").agg(F.sum(F.col("__v") * share).alias("value"))
