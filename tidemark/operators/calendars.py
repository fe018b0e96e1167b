"""Trading calendars as tables (date, session, start_ms, end_ms), and what they say about instants and bars.

A calendar has a few rows a day, a bounded number, so it is broadcast; instants meet it by their UTC day."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MS, MINUTE_MS = 86_400_000, 60_000
#: Minutes of the UTC day at which the cycle's sessions begin and end (fixed values).
UTC_SESSIONS = {"day": (0, 480), "pre": (480, 810), "regular": (810, 1200), "after": (1200, 1430)}


def weekday_calendar(spark: SparkSession, first: str, last: str, holidays: Iterable[str] = ()) -> DataFrame:
    """The sessions of every weekday from first to last that isn't a holiday."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    open_ = days.where(F.weekday("date") < 5)
    if holidays := list(holidays):
        open_ = open_.where(~F.col("date").isin(*[F.lit(x).cast("date") for x in holidays]))
    made = F.array(*[F.struct(F.lit(n).alias("session"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in UTC_SESSIONS.items()])
    midnight = F.unix_date("date").cast("long") * DAY_MS
    at = lambda c: (midnight + F.col(c).cast("long") * MINUTE_MS)
    return open_.select("date", F.inline(made)).select("date", "session", at("a").alias("start_ms"), at("b").alias("end_ms"))


def day_of(ts_ms: Column) -> Column:
    return F.floor(ts_ms / DAY_MS)


def locate(df: DataFrame, calendar: DataFrame, time: str = "ts_ms") -> DataFrame:
    """df with the date and session whose [start, end) holds its time; null where the market is closed."""
    spans = calendar.select("date", "session", "start_ms", "end_ms").withColumn("__d", F.explode(F.sequence(day_of(F.col("start_ms")), day_of(F.col("end_ms") - 1))))
    inside = (day_of(F.col(time)) == F.col("__d")) & (F.col(time) >= F.col("start_ms")) & (F.col(time) < F.col("end_ms"))
    return df.join(F.broadcast(spans), inside, "left").drop("__d", "start_ms", "end_ms")


def next_transition(df: DataFrame, calendar: DataFrame, time: str = "ts_ms") -> DataFrame:
    """df with next_edge_ms: the first begin or end of a session after its time; null beyond the calendar.

    Each UTC day knows its own edges and the first one after it."""
    edges = calendar.select(F.explode(F.array("start_ms", "end_ms")).alias("edge")).distinct().withColumn("__d", day_of(F.col("edge")))
    first = edges.groupBy("__d").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    # days before the calendar meet no row; days without edges take those of the next day that has any
    span = edges.agg(F.min("__d").alias("a"), F.max("__d").alias("b")).select(F.explode(F.sequence("a", "b")).alias("__d"))
    w = Window.orderBy("__d").rowsBetween(1, Window.unboundedFollowing)  # one row a day of the calendar
    days = span.join(first, "__d", "left").withColumn("after", F.first(F.get("edges", F.lit(0)), ignorenulls=True).over(w))
    own = F.array_min(F.filter("edges", lambda e: e > F.col(time)))
    out = df.withColumn("__d", day_of(F.col(time))).join(F.broadcast(days), "__d", "left")
    return out.withColumn("next_edge_ms", F.coalesce(own, F.col("after"))).drop("__d", "edges", "after")


def spans(calendar: DataFrame) -> DataFrame:
    """(date, from_ms, to_ms, regular_ms, cutoff_ms): each trading day from its first session's begin to its last one's end,
    and a day before its regular session (else the first one) begins."""
    regular = F.min(F.when(F.col("session") == "regular", F.col("start_ms")))
    out = calendar.groupBy("date").agg(F.min("start_ms").alias("from_ms"), F.max("end_ms").alias("to_ms"), regular.alias("regular_ms"))
    return out.withColumn("cutoff_ms", F.coalesce("regular_ms", "from_ms") - DAY_MS)


def assign_days(bars: DataFrame, calendar: DataFrame, width_ms: int, time: str = "ts_ms") -> DataFrame:
    """bars with the trading day that their interval begins in, and whether it is the UTC date because no span holds it."""
    days = spans(calendar).select("date", "from_ms", "to_ms").withColumn("__d", F.explode(F.sequence(day_of(F.col("from_ms")), day_of(F.col("to_ms") - 1))))
    begin = F.col(time) - width_ms
    inside = (day_of(begin) == F.col("__d")) & (begin >= F.col("from_ms")) & (begin < F.col("to_ms"))
    out = bars.join(F.broadcast(days), inside, "left").drop("__d", "from_ms", "to_ms")
    utc = F.date_add(F.lit("1970-01-01").cast("date"), day_of(begin).cast("int"))
    return out.withColumn("fallback", F.col("date").isNull()).withColumn("date", F.coalesce("date", utc))


def window_dates(calendar: DataFrame, asked: DataFrame, count: int, skip: Iterable[str] = ()) -> DataFrame:
    """(as_of, date): the last `count` trading dates strictly before each as_of, but for those skipped."""
    dates = calendar.select("date").distinct()
    if skip := list(skip):
        dates = dates.where(~F.col("date").isin(*[F.lit(x).cast("date") for x in skip]))
    days = dates.select("date", F.lit(1).alias("__n")).unionByName(asked.select(F.col("as_of").alias("date"), F.lit(0).alias("__n"))).groupBy("date").agg(F.max("__n").alias("__n"))
    numbered = days.withColumn("__k", F.sum("__n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))  # one row a day
    of = numbered.where("__n = 1").select("date", "__k")
    before = F.col("__k") - F.col("__n")  # trading dates before the day itself
    wanted = numbered.select(F.col("date").alias("as_of"), F.explode(F.when(before > 0, F.sequence(F.greatest(before - (count - 1), F.lit(1)), before))).alias("__k"))
    return asked.select("as_of").join(wanted, "as_of").join(of, "__k").select("as_of", "date")
