"""Registered queries of the event inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import inventory as I
from tidemark.operators import quality as Q
from tidemark.plans.queries import DAY, HOUR, RANKS, query
from tidemark.sources import views as V

CELLS = I.Cells(tops=(10, 20), jumps=(10, 30), jump_from=((11, 30), (31, 100)), stays=(2, 3))
WINDOWS = {"1d": DAY, "3d": 3 * DAY}
STALE, SPAN, OUTAGE, GAP = DAY, 2 * DAY, 3 * HOUR, 5 * DAY

INVENTORY = (
    RANKS
    + f""", near AS (SELECT *, lag(idx) OVER w AS pi, lag(rank) OVER w AS pr, lead(idx, 1) OVER w AS i1, lead(rank, 1) OVER w AS r1, lead(idx, 2) OVER w AS i2, lead(rank, 2) OVER w AS r2
  FROM numbered WINDOW w AS (PARTITION BY ranking_type, symbol ORDER BY idx)),
 entered AS (SELECT n.*, top FROM near n, (VALUES (10), (20)) t(top) WHERE idx > 1 AND rank <= top AND NOT coalesce(pi = idx - 1 AND pr <= top, false)),
 jumped AS (SELECT n.*, jump FROM near n, (VALUES (10), (30)) j(jump) WHERE pi = idx - 1 AND pr - rank >= jump),
 labels AS (SELECT ranking_type, snap_ms, symbol, 'new_entry' AS kind, 'top' || top AS cell FROM entered
  UNION ALL SELECT ranking_type, snap_ms, symbol, 'dwell_start', 'top' || top || '_for2' FROM entered WHERE i1 = idx + 1 AND r1 <= top
  UNION ALL SELECT ranking_type, snap_ms, symbol, 'dwell_start', 'top' || top || '_for3' FROM entered WHERE i1 = idx + 1 AND r1 <= top AND i2 = idx + 2 AND r2 <= top
  UNION ALL SELECT ranking_type, snap_ms, symbol, 'rank_jump', 'by' || jump FROM jumped
  UNION ALL SELECT ranking_type, snap_ms, symbol, 'rank_jump', 'by' || jump || '_from' || lo || '_' || hi FROM jumped, (VALUES (11, 30), (31, 100)) f(lo, hi) WHERE pr BETWEEN lo AND hi),
 found AS (SELECT DISTINCT ranking_type, snap_ms, symbol FROM labels),
 outages AS (SELECT ts_ms AS lo, ts_ms + {OUTAGE} AS hi FROM ticks WHERE kind = 'error' AND symbol % 10 = 0),
 times AS (SELECT DISTINCT symbol, ts_ms FROM trades), steps AS (SELECT symbol, lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS lo, ts_ms AS hi FROM times), gaps AS (SELECT * FROM steps WHERE hi - lo > {GAP}),
 meets AS (SELECT f.ranking_type, f.snap_ms, f.symbol, string_agg(DISTINCT l.kind, ',' ORDER BY l.kind) AS overlapping, count(DISTINCT l.ranking_type || l.snap_ms) - 1 AS n_overlapping
  FROM found f JOIN labels l ON l.symbol = f.symbol AND abs(l.snap_ms - f.snap_ms) <= {SPAN} GROUP BY ALL),
 counted AS (SELECT f.ranking_type, f.snap_ms, f.symbol, count(*) FILTER (t.ts_ms >= f.snap_ms - {DAY} AND t.ts_ms < f.snap_ms) AS n_before, count(*) FILTER (t.ts_ms > f.snap_ms AND t.ts_ms <= f.snap_ms + {DAY}) AS n_1d,
  count(*) FILTER (t.ts_ms > f.snap_ms AND t.ts_ms <= f.snap_ms + {3 * DAY}) AS n_3d, count(*) FILTER (t.ts_ms // {DAY} = f.snap_ms // {DAY}) = 0 AS no_tape FROM found f LEFT JOIN trades t ON t.symbol = f.symbol GROUP BY ALL),
 priced AS (SELECT f.ranking_type, f.snap_ms, f.symbol, max_by(t.price_u, (t.ts_ms, t.event_id)) / 1000000.0 AS px FROM found f LEFT JOIN ticks t ON t.symbol = f.symbol AND t.ts_ms <= f.snap_ms GROUP BY ALL),
 clock AS (SELECT ranking_type, snap_ms, snap_ms - lag(snap_ms) OVER (PARTITION BY ranking_type ORDER BY snap_ms) AS prev_gap_ms, (snap_ms // 60000 + 540) % 1440 AS m FROM snaps),
 inventory AS (SELECT l.ranking_type, l.snap_ms, l.symbol, l.kind, l.cell, k.prev_gap_ms, m.overlapping, m.n_overlapping, c.n_before, c.n_1d, c.n_3d, c.no_tape, k.prev_gap_ms > {STALE} AS stale_prev,
  c.n_before = 0 AS zero_before, c.n_1d = 0 AS zero_1d, c.n_3d = 0 AS zero_3d, CAST(DATE '1970-01-01' + CAST(l.snap_ms // {DAY} AS INTEGER) AS VARCHAR) AS session,
  CASE WHEN k.m >= 540 AND k.m < 1020 THEN 'day' WHEN k.m >= 1020 AND k.m < 1350 THEN 'pre' WHEN k.m >= 1350 OR k.m < 300 THEN 'regular' WHEN k.m >= 300 AND k.m < 530 THEN 'after' ELSE 'closed' END AS band,
  CASE WHEN p.px IS NULL OR p.px <= 0 THEN 'unknown' WHEN p.px < 0.5 THEN '$0.10-0.50' WHEN p.px < 1 THEN '$0.50-1' WHEN p.px < 2 THEN '$1-2' WHEN p.px < 5 THEN '$2-5' WHEN p.px < 20 THEN '$5-20' ELSE '$20+' END AS price_band,
  coalesce(u.c_mktsegment, 'unknown') AS market,
  EXISTS (SELECT 1 FROM outages o WHERE o.lo <= l.snap_ms + {DAY} AND o.hi >= l.snap_ms) AS down_1d, EXISTS (SELECT 1 FROM outages o WHERE o.lo <= l.snap_ms + {3 * DAY} AND o.hi >= l.snap_ms) AS down_3d,
  EXISTS (SELECT 1 FROM gaps g WHERE g.symbol = l.symbol AND g.lo <= l.snap_ms + {DAY} AND g.hi >= l.snap_ms) AS gap_1d, EXISTS (SELECT 1 FROM gaps g WHERE g.symbol = l.symbol AND g.lo <= l.snap_ms + {3 * DAY} AND g.hi >= l.snap_ms) AS gap_3d
  FROM labels l JOIN meets m USING (ranking_type, snap_ms, symbol) JOIN counted c USING (ranking_type, snap_ms, symbol) JOIN priced p USING (ranking_type, snap_ms, symbol) JOIN clock k USING (ranking_type, snap_ms) LEFT JOIN customer u ON u.c_custkey = l.symbol)"""
)


def inventory(spark, sf_dir):
    """One row for each event and label. Outages are three hours after the errors of every tenth symbol, for all symbols."""
    ticks, trades = V.ticks(spark, sf_dir), V.trades(spark, sf_dir)
    outages = ticks.where("kind = 'error' and symbol % 10 = 0").select(F.col("ts_ms").alias("lo_ms"), (F.col("ts_ms") + OUTAGE).alias("hi_ms"))
    gaps = Q.time_gaps(trades, "symbol", "ts_ms", GAP).select("symbol", F.col("gap_from_ms").alias("lo_ms"), F.col("gap_to_ms").alias("hi_ms"))
    about = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("market"))
    return I.inventory(V.rankings(spark, sf_dir), ticks, trades, outages, gaps, about, CELLS, SPAN, DAY, STALE, WINDOWS)


_COLUMNS = (
    "ranking_type snap_ms symbol kind cell prev_gap_ms overlapping n_overlapping n_before n_1d n_3d no_tape stale_prev zero_before zero_1d zero_3d session band price_band market down_1d down_3d gap_1d gap_3d"
).split()


@query(f"WITH {INVENTORY} SELECT {', '.join(_COLUMNS)} FROM inventory")
def event_inventory(spark, sf_dir):
    """EVT-09, JOIN-12: each ranking event under every kind it is, with the kinds that overlap it as a set, tape coverage
    and strata."""
    out = inventory(spark, sf_dir).withColumn("overlapping", F.array_join("overlapping", ",")).withColumn("session", F.col("session").cast("string"))
    return out.select(*_COLUMNS)


@query(
    f"""WITH {INVENTORY} SELECT ranking_type, session, band, kind, cell, price_band, market, count(*) AS n, count(*) FILTER (no_tape) AS n_no_tape, count(*) FILTER (stale_prev) AS n_stale_prev, count(*) FILTER (zero_before) AS n_zero_before,
 count(*) FILTER (zero_1d) AS n_zero_1d, count(*) FILTER (down_1d) AS n_down_1d, count(*) FILTER (gap_1d) AS n_gap_1d, count(*) FILTER (zero_3d) AS n_zero_3d, count(*) FILTER (down_3d) AS n_down_3d, count(*) FILTER (gap_3d) AS n_gap_3d,
 CAST(sum(n_before) AS BIGINT) AS sum_before, CAST(sum(n_1d) AS BIGINT) AS sum_1d, CAST(sum(n_3d) AS BIGINT) AS sum_3d FROM inventory GROUP BY ALL"""
)
def inventory_cube(spark, sf_dir):
    """AGG-06, 07, EVT-09: the inventory folded to sums by stratum."""
    out = I.cube(inventory(spark, sf_dir), WINDOWS)
    return out.withColumn("session", F.col("session").cast("string"))


@query(
    f"""WITH {INVENTORY}, c AS (SELECT kind, cell, sum(1) AS n, count(*) FILTER (NOT no_tape AND NOT down_1d AND NOT gap_1d) AS n_known, count(*) FILTER (NOT no_tape AND NOT down_1d AND NOT gap_1d AND zero_1d) AS n_quiet FROM inventory GROUP BY ALL)
 SELECT kind, cell, CAST(n AS BIGINT) AS n, n_known, n_quiet, round(n_known / CAST(n AS DOUBLE), 6) AS known_share, round(n_quiet / CAST(nullif(n_known, 0) AS DOUBLE), 6) AS quiet_share FROM c"""
)
def inventory_cells(spark, sf_dir):
    """AGG-07: by kind and cell, how many events have a tape to judge by, and how many of these were quiet."""
    known = ~(F.col("no_tape") | F.col("down_1d") | F.col("gap_1d"))
    c = inventory(spark, sf_dir).groupBy("kind", "cell").agg(F.count("*").alias("n"), F.count_if(known).alias("n_known"), F.count_if(known & F.col("zero_1d")).alias("n_quiet"))
    return c.select("*", F.round(F.col("n_known") / F.col("n"), 6).alias("known_share"), F.round(F.try_divide("n_quiet", "n_known"), 6).alias("quiet_share"))
