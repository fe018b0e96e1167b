"""Registered queries of the log operators, over a log that is written from the events: older lines compressed, as rotation
leaves them, newer ones plain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.queries import DAY, HOUR, TICKS, query, rounded
from tidemark.sources import logs as L
from tidemark.sources import views as V
from tidemark.streaming.replay import shared_folder

#: What each kind of event becomes in the log: gaps of purchases, telemetry of views, starts of errors, transitions of signups.
LOG = (
    TICKS
    + """, seen AS (SELECT *, lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, event_id) AS prev_ms FROM trades), gaps AS (SELECT ts_ms, 'S' || symbol AS symbol, prev_ms, ts_ms AS cur_ms, qty_u // 1000000 AS n, (ts_ms - prev_ms) / 1000.0 AS hole_s FROM seen WHERE prev_ms < ts_ms),
 told AS (SELECT ts_ms, 'c' || symbol % 7 AS sig, price_u // 10000000 AS md, qty_u // 1000000 AS rk FROM ticks WHERE kind = 'view')"""
)


def written_log(spark, sf_dir):
    """The log's lines, by way of files."""
    ticks = V.ticks(spark, sf_dir)
    prev = F.lag("ts_ms").over(Window.partitionBy("symbol").orderBy("ts_ms", "event_id"))
    whole = lambda c, unit: F.expr(f"{c} div {unit}").cast("string")
    trades = ticks.where("kind = 'purchase'").withColumn("prev_ms", prev).where("prev_ms < ts_ms")
    gap = trades.select("ts_ms", F.lit("WARNING").alias("level"), F.format_string("tape gap S%d: prev_max=%d < this_min=%d (n=%s)", "symbol", "prev_ms", "ts_ms", whole("qty_u", 1_000_000)).alias("m"))
    pulse = ticks.where("kind = 'view'").select(
        "ts_ms", F.lit("INFO"), F.concat(F.lit("telemetry config_sig=c0 md_peak_1s="), whole("price_u", 10_000_000), F.lit(" rank_peak_1s="), whole("qty_u", 1_000_000), F.lit(" config_sig=c"), (F.col("symbol") % 7).cast("string"))
    )
    start = ticks.where("kind = 'error'").select("ts_ms", F.lit("ERROR"), F.lit("collector started"))
    turn = ticks.where("kind = 'signup'").select("ts_ms", F.lit("INFO"), F.concat(F.lit("session s"), (F.col("symbol") % 4).cast("string"), F.lit(" -> s"), ((F.col("symbol") + 1) % 4).cast("string")))
    every = gap.union(pulse).union(start).union(turn)
    stamp = F.concat(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.lpad(F.pmod("ts_ms", F.lit(1000)).cast("string"), 3, "0"))
    lines = every.select(F.concat_ws(" ", stamp, "level", "m").alias("value"), F.pmod(F.floor(F.col("ts_ms") / DAY), F.lit(2)).alias("old"))
    folder = shared_folder(spark)
    lines.where("old = 1").select("value").write.option("compression", "gzip").text(f"{folder}/rotated")
    lines.where("old = 0").select("value").write.text(f"{folder}/live")
    return L.log_lines(spark, folder)


@query(f"WITH {LOG} SELECT ts_ms, symbol, prev_ms, cur_ms, n, hole_s, cur_ms - prev_ms > {36 * HOUR} AS reentry, n >= 50 AS at_cap FROM gaps")
def log_tape_gaps(spark, sf_dir):
    """SRC-19, 20: the gaps that a log tells of, true holes and re-entries."""
    return L.tape_gaps(written_log(spark, sf_dir), reentry_ms=36 * HOUR, cap=50)


@query(
    f"""WITH {LOG}, g AS (SELECT *, cur_ms - prev_ms > {36 * HOUR} AS reentry, n >= 50 AS at_cap FROM gaps) SELECT count(*) AS n_lines, count(*) FILTER (reentry) AS n_reentry, count(*) FILTER (NOT reentry) AS n_holes, count(*) FILTER (NOT reentry AND at_cap) AS n_capped,
 round(quantile_cont(hole_s, 0.5) FILTER (NOT reentry), 4) AS hole_s_p50, round(quantile_cont(hole_s, 0.9) FILTER (NOT reentry), 4) AS hole_s_p90, round(quantile_cont(hole_s, 0.5) FILTER (NOT reentry AND at_cap), 4) AS capped_s_p50, round(quantile_cont(hole_s, 0.9) FILTER (NOT reentry AND at_cap), 4) AS capped_s_p90,
 round(count(*) FILTER (NOT reentry AND at_cap) / CAST(nullif(count(*) FILTER (NOT reentry), 0) AS DOUBLE), 6) AS capped_share FROM g"""
)
def log_gap_summary(spark, sf_dir):
    """SRC-20: holes and how full the polls were."""
    out = L.gap_summary(L.tape_gaps(written_log(spark, sf_dir), reentry_ms=36 * HOUR, cap=50))
    return rounded(rounded(out, "hole_s_p50", "hole_s_p90", "capped_s_p50", "capped_s_p90", digits=4), "capped_share")


@query(f"WITH {LOG} SELECT symbol, count(*) AS n_gaps, max(hole_s) AS longest_s FROM gaps WHERE cur_ms - prev_ms <= {36 * HOUR} GROUP BY symbol ORDER BY n_gaps DESC, symbol LIMIT 10")
def log_worst_symbols(spark, sf_dir):
    """SRC-20: the symbols with most holes."""
    return L.worst_symbols(L.tape_gaps(written_log(spark, sf_dir), reentry_ms=36 * HOUR, cap=50))


@query(
    f"""WITH {LOG}, w AS (SELECT * FROM told WHERE ts_ms BETWEEN 1704412800000 AND 1706140800000), r AS (SELECT ts_ms // {DAY} * {DAY} AS start_ms, md, rk, row_number() OVER (PARTITION BY ts_ms // {DAY} ORDER BY md) AS im, row_number() OVER (PARTITION BY ts_ms // {DAY} ORDER BY rk) AS ir, count(*) OVER (PARTITION BY ts_ms // {DAY}) AS c FROM w)
 SELECT start_ms, count(*) AS n, (SELECT string_agg(DISTINCT sig, ',' ORDER BY sig) FROM w WHERE w.ts_ms // {DAY} * {DAY} = r.start_ms) AS signatures, max(md) AS md_peak_1s_max, max(rk) AS rank_peak_1s_max,
 max(md) FILTER (im = CAST(ceil(c * 95 / 100.0) AS BIGINT)) AS md_peak_1s_p95, max(rk) FILTER (ir = CAST(ceil(c * 95 / 100.0) AS BIGINT)) AS rank_peak_1s_p95 FROM r GROUP BY start_ms"""
)
def log_peaks(spark, sf_dir):
    """SRC-21, 22: by day within a window, configurations in force and peaks of the telemetry."""
    told = L.telemetry(L.within(written_log(spark, sf_dir), 1704412800000, 1706140800000))
    return L.windowed_peaks(told, DAY, ("md_peak_1s", "rank_peak_1s")).withColumn("signatures", F.array_join("signatures", ","))


@query(
    f"""WITH {LOG}, every AS (SELECT ts_ms, false AS r FROM gaps UNION ALL SELECT ts_ms, false FROM told UNION ALL SELECT ts_ms, kind = 'error' FROM ticks WHERE kind IN ('error', 'signup')), t AS (SELECT ts_ms, bool_or(r) AS r FROM every GROUP BY ts_ms), l AS (SELECT ts_ms, r, lag(ts_ms) OVER (ORDER BY ts_ms) AS last_ms FROM t)
 SELECT ts_ms, CAST(last_ms AS DOUBLE) AS last_ms, CAST(ts_ms - last_ms AS DOUBLE) AS silent_ms FROM l WHERE r"""
)
def log_restarts(spark, sf_dir):
    """SRC-19, 21: restarts and the silence before them."""
    out = L.restarts(written_log(spark, sf_dir), "^collector started$")
    return out.select("ts_ms", F.col("last_ms").cast("double").alias("last_ms"), F.col("silent_ms").cast("double").alias("silent_ms"))


@query(f"WITH {LOG} SELECT 's' || symbol % 4 AS from_session, 's' || (symbol + 1) % 4 AS to_session, count(*) AS n FROM ticks WHERE kind = 'signup' GROUP BY ALL")
def log_transitions(spark, sf_dir):
    """SRC-21: changes of session that a log tells of."""
    return L.transitions(written_log(spark, sf_dir)).groupBy("from_session", "to_session").agg(F.count("*").alias("n"))
