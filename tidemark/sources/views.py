"""Market-shaped views over the star-schema tables: the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    """Epoch milliseconds of a timestamp without time zone, taken as UTC, rounded down."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column}) div 1000")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, event_id, ts_ms, price_u, qty_u, kind): every event as a print of its user's symbol, in micro units."""
    return as_ticks(table(spark, sf_dir, "events"))


def as_ticks(events: DataFrame) -> DataFrame:
    """The events table, or a stream of it, in the shape of ticks."""
    return events.select(
        F.col("user_id").alias("symbol"),
        "event_id",
        millis("ts").alias("ts_ms"),
        F.round(F.col("value") * 1_000_000).cast("long").alias("price_u"),
        (F.get_json_object("props", "$.k").cast("long") * 1_000_000).alias("qty_u"),
        F.col("event_type").alias("kind"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where("kind = 'purchase'").drop("kind")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, event_id, ts_ms, mid_u)."""
    return ticks(spark, sf_dir).where("kind = 'view'").select("symbol", "event_id", "ts_ms", F.col("price_u").alias("mid_u"))


def candles_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier's line items: (symbol, day, open_u, high_u, low_u, close_u, vol)."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") * 1_000_000).cast("long").alias("price_u"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("q")).alias("at"),
    )
    # dealt before they are aggregated: a day has an item or two, and first sums that save no rows would be sorted and shuffled
    return items.repartition("symbol", "day").groupBy("symbol", "day").agg(
        F.min_by("price_u", "at").alias("open_u"),
        F.max("price_u").alias("high_u"),
        F.min("price_u").alias("low_u"),
        F.max_by("price_u", "at").alias("close_u"),
        F.sum("qty").alias("vol"),
    )


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snap_ms, ranking_type, rank, symbol, amount): each day's users by all events, and by purchases."""
    daily = ticks(spark, sf_dir).withColumn("snap_ms", F.floor(F.col("ts_ms") / DAY_MS) * DAY_MS)
    both = daily.select("snap_ms", "symbol", F.lit("events").alias("ranking_type"), "price_u").union(
        daily.where("kind = 'purchase'").select("snap_ms", "symbol", F.lit("purchases"), "price_u")
    )
    order = Window.partitionBy("snap_ms", "ranking_type").orderBy(F.desc("amount"), "symbol")
    return both.groupBy("snap_ms", "ranking_type", "symbol").agg(F.sum("price_u").alias("amount")).withColumn("rank", F.row_number().over(order))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, seq, ts_ms, to_tier): a customer's orders as tier changes, by status F, O, P = 1, 2, 3."""
    tier = F.expr("case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("seq"), millis("o_orderdate").alias("ts_ms"), tier.alias("to_tier"))


def books(spark: SparkSession, sf_dir: str, levels: int = 5) -> DataFrame:
    """(book, bids, asks): order books of parts, made from retail prices: arrays of (price_u, qty_u), best first."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), F.round(F.col("p_retailprice") * 1_000_000).cast("long").alias("px"), F.col("p_size").cast("long").alias("size"))
    side = lambda sign: F.transform(
        F.sequence(F.lit(1), F.lit(levels)), lambda i: F.struct((F.col("px") + sign * i * 10_000 * F.col("size")).alias("price_u"), (F.col("size") * i * 100_000).alias("qty_u"))
    )
    return part.select("book", side(-1).alias("bids"), side(1).alias("asks"))
