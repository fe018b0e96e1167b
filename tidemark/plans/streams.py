"""Registered queries of the stateful operators: streams run over the stored tables, and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.bars import float_ratio
from tidemark.plans.queries import DAY, HOUR, TICKS, query
from tidemark.sources import views as V
from tidemark.streaming import tiers as Z
from tidemark.streaming.replay import run_to_end, shared_folder, table_stream
from tidemark.streaming.versions import VersionedTable, enriched

RULES = Z.TierRules(up=(0.3, 0.6), down=(0.22, 0.5), hold_ms=6 * HOUR, stale_ms=2 * DAY)
POOL = Z.PoolRules(capacity=12, floor=0.35, margin=0.08, hold_ms=12 * HOUR)

#: One step of recursion hears one score of every symbol; before it come at most two changes that silence brought.
TIERS = (
    TICKS
    + f""", horizon AS (SELECT max(ts_ms) - {DAY} AS h FROM ticks), scores AS (SELECT symbol, ts_ms, price_u / 500000000.0 AS score, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, event_id) AS k FROM ticks, horizon WHERE ts_ms <= h),
 steps AS (SELECT * FROM scores UNION ALL SELECT symbol, any_value(h), NULL, max(k) + 1 FROM scores, horizon GROUP BY symbol),
 machine AS (SELECT symbol, CAST(0 AS BIGINT) AS k, 1 AS tier, CAST(NULL AS BIGINT) AS changed, CAST(NULL AS BIGINT) AS below, CAST(NULL AS BIGINT) AS last, CAST(NULL AS DOUBLE) AS score,
   CAST(NULL AS BIGINT) AS s1, CAST(NULL AS BIGINT) AS s2, 1 AS tier0, CAST(NULL AS DOUBLE) AS old_score, CAST(NULL AS BIGINT) AS heard_ms, 1 AS heard_at, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT symbol FROM scores)
  UNION ALL SELECT symbol, k, CASE reason WHEN 'score' THEN tier + 1 WHEN 'score_decay' THEN tier - 1 ELSE tier END, CASE WHEN reason IS NOT NULL THEN t ELSE changed END,
   CASE WHEN sc IS NULL THEN below WHEN wanted >= tier OR sc >= line THEN NULL WHEN below IS NULL THEN t WHEN t - below >= {6 * HOUR} THEN NULL ELSE below END, CASE WHEN sc IS NULL THEN last ELSE t END, coalesce(sc, score), s1, s2, tier0, score, t, tier, reason
  FROM (SELECT *, CASE WHEN sc IS NULL THEN NULL WHEN wanted > tier AND (changed IS NULL OR t - changed >= {6 * HOUR}) THEN 'score' WHEN wanted < tier AND sc < line AND t - below >= {6 * HOUR} AND (changed IS NULL OR t - changed >= {6 * HOUR}) THEN 'score_decay' END AS reason
   FROM (SELECT *, CASE tier WHEN 2 THEN 0.22 WHEN 3 THEN 0.5 END AS line, 1 + CAST(sc >= 0.3 AS INTEGER) + CAST(sc >= 0.6 AS INTEGER) AS wanted
   FROM (SELECT symbol, k, t, sc, score, below, last, tier AS tier0, s1, s2, tier - CAST(s1 IS NOT NULL AS INTEGER) - CAST(s2 IS NOT NULL AS INTEGER) AS tier, coalesce(s2, s1, changed) AS changed
   FROM (SELECT *, CASE WHEN s1 IS NOT NULL AND tier > 2 AND s1 + {6 * HOUR} <= t THEN s1 + {6 * HOUR} END AS s2
   FROM (SELECT m.symbol, n.k, n.ts_ms AS t, n.score AS sc, m.score, m.below, m.last, m.tier, m.changed, CASE WHEN m.tier > 1 AND greatest(m.last + {2 * DAY}, coalesce(m.changed + {6 * HOUR}, 0)) <= n.ts_ms THEN greatest(m.last + {2 * DAY}, coalesce(m.changed + {6 * HOUR}, 0)) END AS s1
   FROM machine m JOIN steps n ON n.symbol = m.symbol AND n.k = m.k + 1))))))
 SELECT symbol, s1 AS ts_ms, tier0 AS from_tier, tier0 - 1 AS to_tier, 'stale' AS reason, old_score AS score FROM machine WHERE s1 IS NOT NULL
 UNION ALL SELECT symbol, s2, tier0 - 1, tier0 - 2, 'stale', old_score FROM machine WHERE s2 IS NOT NULL
 UNION ALL SELECT symbol, heard_ms, heard_at, tier, reason, score FROM machine WHERE reason IS NOT NULL"""
)


def scored(ticks):
    return ticks.select("symbol", "ts_ms", F.col("event_id").alias("tie"), (F.col("price_u") / 500_000_000.0).alias("score"))


def horizon(spark, sf_dir) -> int:
    """A day before the last print: how far a stream's watermark with that delay comes."""
    return (V.ticks(spark, sf_dir).agg(F.max("ts_ms")).first()[0] or 0) - DAY


@query(f"WITH RECURSIVE {TIERS}")
def tier_machine(spark, sf_dir):
    """STR-09, JOIN-15: tier changes by score, decay and silence, with holds."""
    return Z.tier_machine(scored(V.ticks(spark, sf_dir)), RULES, horizon(spark, sf_dir))


@query(f"WITH RECURSIVE {TIERS}")
def tier_machine_stream(spark, sf_dir):
    """STR-09: the same, of the stored prints run as a stream with timers."""
    ticks = V.as_ticks(table_stream(spark, f"{sf_dir}/events.parquet"))
    return run_to_end(Z.tier_machine_stream(scored(ticks), RULES, "1 day"))


def pool_scores(spark, sf_dir):
    """Five pools of symbols; a day's amount of a symbol as its score at the day's start."""
    ranks = V.rankings(spark, sf_dir).where("ranking_type = 'events'")
    return ranks.select((F.col("symbol") % 5).alias("pool"), F.col("snap_ms").alias("ts_ms"), "symbol", (F.col("amount") / 600_000_000.0).alias("score"))


@query()
def pool_seats(spark, sf_dir):
    """STR-10: seats of five pools by score, with a floor, a margin and a hold (tested against a plain simulation)."""
    return Z.pool_seats(pool_scores(spark, sf_dir), POOL, horizon(spark, sf_dir))


HISTORY = f"""WITH {TICKS}, origin AS (SELECT min(ts_ms) // {DAY} * {DAY} AS o FROM ticks), past AS (SELECT symbol, ts_ms // {DAY} AS d, sum(qty_u) AS q FROM trades, origin WHERE ts_ms < o + {10 * DAY} GROUP BY ALL),
 base AS (SELECT symbol, count(*) AS n_days, CAST(sum(q) AS BIGINT) AS total_qu FROM past GROUP BY symbol)"""


@query(
    f"""{HISTORY} SELECT t.symbol, t.event_id, CAST(b.n_days AS DOUBLE) AS n_days, round(t.qty_u / (b.total_qu / CAST(b.n_days AS DOUBLE)), 6) AS day_ratio FROM trades t LEFT JOIN base b USING (symbol), origin WHERE t.ts_ms >= o + {10 * DAY}"""
)
def lazy_baselines(spark, sf_dir):
    """STR-13: a stream of prints against their symbol's daily volume over the first ten days, which is made when a symbol is
    first met and kept in a versioned table."""
    trades = V.trades(spark, sf_dir)
    start = (V.ticks(spark, sf_dir).agg(F.min("ts_ms")).first()[0] or 0) // DAY * DAY + 10 * DAY

    def history(symbols):
        past = trades.where(F.col("ts_ms") < start).join(symbols, "symbol")
        daily = past.groupBy("symbol", F.floor(F.col("ts_ms") / DAY).alias("d")).agg(F.sum("qty_u").alias("q"))
        return daily.groupBy("symbol").agg(F.count("*").alias("n_days"), F.sum("q").alias("total_qu"))

    folder = shared_folder(spark)
    known = VersionedTable(spark, f"{folder}/baselines", "symbol long, n_days long, total_qu long")
    stream = V.as_ticks(table_stream(spark, f"{sf_dir}/events.parquet")).where(f"kind = 'purchase' and ts_ms >= {start}")
    run_to_end(stream, enriched(known, "symbol", lambda epoch: f"{folder}/out/epoch={epoch}", history), folder)
    out = spark.read.schema("symbol long, event_id long, qty_u long, n_days long, total_qu long").parquet(f"{folder}/out")
    day = F.col("total_qu") / F.col("n_days")
    return out.select("symbol", "event_id", F.col("n_days").cast("double").alias("n_days"), F.round(float_ratio(F.col("qty_u"), day), 6).alias("day_ratio"))
