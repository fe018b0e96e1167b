"""Registered queries of trading calendars; they join those of tidemark.plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sessions as S
from tidemark.operators import calendars as C
from tidemark.operators import temporal as T
from tidemark.plans.queries import DAY, HOUR, HOURS, TICKS, doubles, hours, query
from tidemark.sources import views as V
from tidemark.streaming.replay import shared_folder

CAL = """cal AS (SELECT CAST(d AS DATE) AS date, s AS session, epoch_ms(d) + lo * 60000 AS start_ms, epoch_ms(d) + hi * 60000 AS end_ms
 FROM range(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-11', INTERVAL 1 DAY) r(d), (VALUES ('day', 0, 480), ('pre', 480, 810), ('regular', 810, 1200), ('after', 1200, 1430)) v(s, lo, hi)
 WHERE isodow(d) <= 5 AND CAST(d AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15'))"""


def calendar(spark):
    return C.weekday_calendar(spark, "2023-12-25", "2024-02-10", ("2024-01-01", "2024-01-15"))


@query(
    f"""WITH {TICKS}, {CAL} SELECT CAST(c.date AS VARCHAR) AS date, coalesce(c.session, 'closed') AS session, CAST(max((c.end_ms - c.start_ms) // 60000) AS DOUBLE) AS minutes, count(*) AS n
 FROM ticks t LEFT JOIN cal c ON t.ts_ms >= c.start_ms AND t.ts_ms < c.end_ms GROUP BY ALL"""
)
def located_sessions(spark, sf_dir):
    """FLT-07, EVT-25: prints by the calendar's sessions, with their lengths."""
    cal = calendar(spark)
    found = C.locate(V.ticks(spark, sf_dir), cal).groupBy("date", "session").agg(F.count("*").alias("n"))
    lengths = cal.select("date", "session", ((F.col("end_ms") - F.col("start_ms")) / 60_000).alias("minutes"))
    out = found.join(F.broadcast(lengths), ["date", "session"], "left")
    return out.select(F.col("date").cast("string").alias("date"), F.coalesce("session", F.lit("closed")).alias("session"), "minutes", "n")


@query(
    f"""WITH {TICKS}, {CAL}, edges AS (SELECT start_ms AS e FROM cal UNION SELECT end_ms FROM cal)
 SELECT t.symbol, t.event_id, CAST(e.e AS DOUBLE) AS next_edge_ms FROM trades t ASOF LEFT JOIN edges e ON t.ts_ms < e.e"""
)
def next_transitions(spark, sf_dir):
    """FLT-08: the next begin or end of a session after each trade."""
    return doubles(C.next_transition(V.trades(spark, sf_dir), calendar(spark)).select("symbol", "event_id", "next_edge_ms"), "next_edge_ms")


@query(
    f"""WITH {TICKS}, {CAL}, s AS (SELECT date, min(start_ms) AS from_ms, max(end_ms) AS to_ms, min(start_ms) FILTER (session = 'regular') AS r, epoch_ms(CAST(date AS TIMESTAMP)) AS midnight FROM cal GROUP BY date)
 SELECT CAST(date AS VARCHAR) AS date, from_ms, to_ms, coalesce(r, from_ms) - {DAY} AS cutoff_ms, count(t.ts_ms) AS n_prints FROM s LEFT JOIN ticks t ON t.ts_ms >= midnight AND t.ts_ms < midnight + {DAY} GROUP BY ALL"""
)
def trading_days(spark, sf_dir):
    """FLT-09, 10: each trading day's span, the cutoff for daily bars, and the prints within 24 hours of its midnight."""
    prints = V.ticks(spark, sf_dir).groupBy(C.day_of(F.col("ts_ms")).alias("d")).agg(F.count("*").alias("n"))
    days = C.spans(calendar(spark)).withColumn("d", F.unix_date("date").cast("long")).join(prints, "d", "left")
    return days.select(F.col("date").cast("string").alias("date"), "from_ms", "to_ms", "cutoff_ms", F.coalesce("n", F.lit(0)).alias("n_prints"))


@query(
    f"""WITH {HOURS}, {CAL}, s AS (SELECT date, min(start_ms) AS a, max(end_ms) AS b FROM cal GROUP BY date)
 SELECT h.symbol, h.ts_ms, CAST(coalesce(s.date, CAST(DATE '1970-01-01' + CAST((h.ts_ms - {HOUR}) // {DAY} AS INTEGER) AS DATE)) AS VARCHAR) AS date, s.date IS NULL AS fallback
 FROM hours h LEFT JOIN s ON h.ts_ms - {HOUR} >= s.a AND h.ts_ms - {HOUR} < s.b"""
)
def market_days(spark, sf_dir):
    """FLT-11, EVT-02: the trading day of each bar, UTC days where the market is closed."""
    out = C.assign_days(hours(spark, sf_dir).select("symbol", "ts_ms"), calendar(spark), HOUR)
    return out.withColumn("date", F.col("date").cast("string"))


@query(
    f"""WITH {HOURS}, a AS (SELECT t.event_id, h.ts_ms, h.close_u FROM trades t ASOF LEFT JOIN hours h ON t.symbol = h.symbol AND t.ts_ms // {HOUR} * {HOUR} >= h.ts_ms),
 b AS (SELECT t.event_id, h.ts_ms, h.close_u FROM trades t ASOF LEFT JOIN hours h ON t.symbol = h.symbol AND t.ts_ms // {HOUR} * {HOUR} > h.ts_ms)
 SELECT event_id, CAST(a.ts_ms AS DOUBLE) AS last_ms, CAST(b.ts_ms AS DOUBLE) AS strict_ms, CAST(a.close_u - b.close_u AS DOUBLE) AS close_delta_u FROM a JOIN b USING (event_id)"""
)
def cut_frames(spark, sf_dir):
    """FLT-12, 23, STAT-29: the last bar up to, and strictly before, each trade's hour, and what the boundary changes."""
    bars = hours(spark, sf_dir).select("symbol", "ts_ms", "close_u")
    asked = V.trades(spark, sf_dir).select("symbol", "event_id", (F.floor(F.col("ts_ms") / HOUR) * HOUR).cast("long").alias("ts_ms"))
    both = T.asof_join(asked, bars, "symbol", "ts_ms", ["close_u"]).withColumnsRenamed({"right_ts_ms": "last_ms", "close_u": "last_u"})
    both = T.asof_join(both, bars, "symbol", "ts_ms", ["close_u"], strict=True).withColumnRenamed("right_ts_ms", "strict_ms")
    return doubles(both.select("event_id", "last_ms", "strict_ms", (F.col("last_u") - F.col("close_u")).alias("close_delta_u")), "last_ms", "strict_ms", "close_delta_u")


@query(
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) <> DATE '1997-01-10'), a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS as_of FROM lineitem),
 r AS (SELECT as_of, d.date, row_number() OVER (PARTITION BY as_of ORDER BY d.date DESC) AS k FROM a JOIN d ON d.date < a.as_of)
 SELECT CAST(as_of AS VARCHAR) AS as_of, CAST(date AS VARCHAR) AS date FROM r WHERE k <= 5"""
)
def window_dates(spark, sf_dir):
    """WIN-06: the five dates with orders before each date of shipment, one of them left out everywhere."""
    days = lambda name, c, alias: V.table(spark, sf_dir, name).select(F.col(c).cast("date").alias(alias)).distinct()
    out = C.window_dates(days("orders", "o_orderdate", "date"), days("lineitem", "l_shipdate", "as_of"), 5, ("1997-01-10",))
    return out.select(F.col("as_of").cast("string").alias("as_of"), F.col("date").cast("string").alias("date"))


@query(
    f"""WITH {TICKS}, m AS (SELECT ts_ms, CAST(DATE '1970-01-01' + CAST(ts_ms // {DAY} AS INTEGER) AS VARCHAR) AS date, (ts_ms // 60000 + 540) % 1440 AS k FROM ticks)
 SELECT date, CASE WHEN k >= 540 AND k < 1020 THEN 'day' WHEN k >= 1020 AND k < 1350 THEN 'pre' WHEN k >= 1350 OR k < 300 THEN 'regular' WHEN k >= 300 AND k < 530 THEN 'after' ELSE 'closed' END AS session, min(ts_ms) AS start_ms, max(ts_ms) + 1 AS end_ms FROM m GROUP BY ALL"""
)
def calendar_records(spark, sf_dir):
    """SRC-18: the sessions in which there were prints, as one JSON record a day, written and read back."""
    t = F.col("ts_ms")
    seen = V.ticks(spark, sf_dir).groupBy(S.session_date(t).alias("date"), S.session_of(t).alias("session")).agg(F.min(t).alias("start_ms"), (F.max(t) + 1).alias("end_ms"))
    packed = seen.groupBy("date").agg(F.to_json(F.struct("date", F.map_from_entries(F.collect_list(F.struct("session", F.struct("start_ms", "end_ms")))).alias("sessions"))).alias("value"))
    folder = shared_folder(spark)
    packed.select("value").write.text(folder)
    back = spark.read.schema("date date, sessions map<string, struct<start_ms: bigint, end_ms: bigint>>").json(folder)
    return back.select(F.col("date").cast("string").alias("date"), F.explode("sessions").alias("session", "s")).select("date", "session", "s.start_ms", "s.end_ms")
