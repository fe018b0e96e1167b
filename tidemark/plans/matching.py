"""Registered queries of matching in two measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import controls as C
from tidemark.operators import matching as M
from tidemark.operators.temporal import asof_join
from tidemark.plans.queries import DAY, HOURS, hours, query, rounded
from tidemark.sources import views as V

RUNGS = (0.1, 0.25, 0.5)
SEEDS, DRAWS, SPREAD = 20, 2, 3.0

#: Events with price and the volume of the bar in force; bars within half as much again in price and a factor of three in volume.
MATCHED = (
    HOURS
    + f""", mb AS (SELECT symbol, ts_ms, close_u, vol_qu FROM hours), me AS (SELECT t.event_id, t.symbol, t.ts_ms, t.price_u AS close_u, h.vol_qu FROM trades t ASOF LEFT JOIN mb h ON t.symbol = h.symbol AND t.ts_ms >= h.ts_ms),
 mf AS (SELECT e.event_id, e.symbol, e.ts_ms, b.ts_ms AS control_ms, greatest(e.close_u, b.close_u) / CAST(least(e.close_u, b.close_u) AS DOUBLE) AS x_ratio, greatest(e.vol_qu, b.vol_qu) <= least(e.vol_qu, b.vol_qu) * {SPREAD} AS in_z, e.close_u AS ex, b.close_u AS bx, e.vol_qu AS ez, b.vol_qu AS bz
  FROM me e JOIN mb b ON b.symbol = e.symbol AND abs(b.ts_ms - e.ts_ms) > {DAY} WHERE e.close_u > 0 AND e.vol_qu > 0 AND b.close_u > 0 AND b.vol_qu > 0 AND CAST(greatest(e.close_u, b.close_u) AS DOUBLE) <= CAST(least(e.close_u, b.close_u) AS DOUBLE) * 1.5),
 mp AS (SELECT event_id, symbol, control_ms, x_ratio, sqrt(pow(abs(ln(ex / CAST(bx AS DOUBLE))) / ln(1.5), 2) + pow(abs(ln(ez / CAST(bz AS DOUBLE))) / ln({SPREAD}), 2)) AS distance FROM mf WHERE in_z)"""
)


def matchable(spark, sf_dir):
    """(events, bars) with close_u and vol_qu."""
    bars = hours(spark, sf_dir).select("symbol", "ts_ms", "close_u", "vol_qu")
    trades = V.trades(spark, sf_dir).select("event_id", "symbol", "ts_ms", F.col("price_u").alias("close_u"))
    return asof_join(trades, bars, "symbol", "ts_ms", ["vol_qu"]).drop("right_ts_ms"), bars


def nearest(spark, sf_dir):
    return M.nearest_bars_once(*matchable(spark, sf_dir), "close_u", "vol_qu", 1 + max(RUNGS), SPREAD, DAY)


@query(
    f"""WITH {MATCHED}, b AS (SELECT event_id, count(*) AS n_x, count(*) FILTER (in_z) AS n_both FROM mf GROUP BY event_id), k AS (SELECT e.event_id, count(h.symbol) AS n_bars, count(h.symbol) FILTER (abs(h.ts_ms - e.ts_ms) > {DAY}) AS n_gap, count(h.symbol) FILTER (abs(h.ts_ms - e.ts_ms) > {DAY} AND h.close_u > 0 AND h.vol_qu > 0) AS n_key
 FROM me e LEFT JOIN mb h ON h.symbol = e.symbol GROUP BY e.event_id) SELECT k.*, coalesce(n_x, 0) AS n_x, coalesce(n_both, 0) AS n_both FROM k LEFT JOIN b USING (event_id)"""
)
def match_rungs(spark, sf_dir):
    """STAT-15, FLT-22, 24: how many control bars each condition leaves of a trade's symbol."""
    return M.rungs(*matchable(spark, sf_dir), "close_u", "vol_qu", 1 + max(RUNGS), SPREAD, DAY)


#: Pairs in order by symbol, taken one by one unless a side is taken.
NEAREST = (
    MATCHED
    + """, mo AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY distance, event_id, control_ms) AS k FROM mp),
 walk AS (SELECT symbol, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS events, CAST([] AS BIGINT[]) AS controls, false AS took, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS control_ms, CAST(NULL AS DOUBLE) AS distance FROM (SELECT DISTINCT symbol FROM mo)
  UNION ALL SELECT o.symbol, o.k, CASE WHEN free THEN list_append(o.events, o.event_id) ELSE o.events END, CASE WHEN free THEN list_append(o.controls, o.control_ms) ELSE o.controls END, free, o.event_id, o.control_ms, o.distance
  FROM (SELECT m.*, w.events, w.controls, NOT list_contains(w.events, m.event_id) AND NOT list_contains(w.controls, m.control_ms) AS free FROM walk w JOIN mo m ON m.symbol = w.symbol AND m.k = w.k + 1) o),
 once AS (SELECT event_id, symbol, control_ms, distance FROM walk WHERE took)"""
)


@query(f"WITH RECURSIVE {NEAREST} SELECT event_id, symbol, control_ms, round(distance, 6) AS distance FROM once")
def nearest_controls(spark, sf_dir):
    """STAT-17: each trade's nearest bar in price and volume, no bar used twice."""
    return rounded(nearest(spark, sf_dir).drop("round"), "distance")


_NUMBERS = [(s, d, *M.multiplier(s, d)) for s in range(SEEDS) for d in range(1, DRAWS + 1)]
#: Every seed's draws from the pools of each rung, and what follows events and drawn bars.
SWEPT = (
    MATCHED
    + f""", pools AS (SELECT event_id, CAST(tol AS DOUBLE) AS tolerance, symbol, control_ms, CAST('0x' || substr(md5(event_id || '-' || CAST(tol AS DOUBLE) || '-' || symbol || '-' || control_ms), 1, 12) AS BIGINT) % {M.PRIME} AS h FROM mp, (VALUES (0.1), (0.25), (0.5)) t(tol) WHERE x_ratio <= 1 + CAST(tol AS DOUBLE)),
 numbers AS (SELECT * FROM (VALUES {', '.join(f'({s}, {d}, {a}, {b})' for s, d, a, b in _NUMBERS)}) v(seed, draw, a, b)),
 swept AS (SELECT event_id, tolerance, symbol, seed, draw, arg_min(control_ms, ((h * CAST(a AS BIGINT) + b) % {M.PRIME}, control_ms)) AS control_ms, count(*) AS n_pool FROM pools, numbers GROUP BY ALL),
 after AS (SELECT symbol, ts_ms, last_value(close_u) OVER w / nullif(CAST(close_u AS DOUBLE), 0) - 1 AS r FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN 1 FOLLOWING AND {3 * DAY} FOLLOWING)),
 real_r AS (SELECT e.event_id, f.r AS real FROM me e ASOF LEFT JOIN after f ON f.symbol = e.symbol AND e.ts_ms >= f.ts_ms)"""
)


def swept(spark, sf_dir, seeds):
    """(event_id, tolerance, symbol, n_pool, drawn) of so many seeds, with r of each drawn bar (see _after).

    Pairs are shuffled once, by event: tolerances, draws and what follows them are found where an event's pairs are."""
    events, bars = matchable(spark, sf_dir)
    pairs = M.near_pairs(events, bars.join(_after(spark, sf_dir), ["symbol", "ts_ms"]), "close_u", "vol_qu", 1 + max(RUNGS), SPREAD, DAY, carry=("r",))
    pairs = pairs.select("event_id", "symbol", "control_ms", "x_ratio", "r").repartition("event_id")
    pairs = pairs.withColumn("tolerance", F.explode(F.array(*map(F.lit, RUNGS)))).where(F.col("x_ratio") <= 1 + F.col("tolerance"))
    return M.draw_pools(pairs, ["event_id", "tolerance", "symbol"], seeds, DRAWS, carry=("r",))


@query(
    f"""WITH {SWEPT}, e AS (SELECT s.tolerance, s.seed, s.event_id, any_value(q.real) AS real, avg(f.r) AS ctrl, any_value(n_pool) AS n_pool FROM swept s JOIN after f ON f.symbol = s.symbol AND f.ts_ms = s.control_ms JOIN real_r q ON q.event_id = s.event_id GROUP BY ALL)
 SELECT tolerance, CAST(seed AS INTEGER) AS seed, count(*) AS n_pairs, round(avg(n_pool), 4) AS mean_pool, round(avg(real - ctrl), 6) AS mean_diff, round(stddev_samp(real - ctrl), 6) AS sd_diff FROM e WHERE real IS NOT NULL AND ctrl IS NOT NULL GROUP BY ALL"""
)
def seed_sweep(spark, sf_dir):
    """STAT-19, 24: what trades are followed by against controls, for three tolerances and twenty seeds."""
    drawn = swept(spark, sf_dir, SEEDS).select("event_id", "tolerance", "n_pool", F.inline("drawn"))
    control = drawn.groupBy("event_id", "tolerance", "seed").agg(F.avg("r").alias("c"), F.any_value("n_pool").alias("n_pool"))
    real = C.forward_outcomes(V.trades(spark, sf_dir).select("event_id", "symbol", "ts_ms"), hours(spark, sf_dir), 3 * DAY).select("event_id", F.col("ret_end").alias("a"))
    both = control.join(real, "event_id").where("a is not null and c is not null").withColumn("d", F.col("a") - F.col("c"))
    out = both.groupBy("tolerance", "seed").agg(F.count("*").alias("n_pairs"), F.avg("n_pool").alias("mean_pool"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"))
    return rounded(rounded(out, "mean_pool", digits=4), "mean_diff", "sd_diff")


def _after(spark, sf_dir):
    """(symbol, ts_ms, r): the return from each bar to the last price within three days of it."""
    from pyspark.sql import Window

    from tidemark.operators.bars import ratio

    w = Window.partitionBy("symbol").orderBy("ts_ms").rangeBetween(1, 3 * DAY)
    return hours(spark, sf_dir).select("symbol", "ts_ms", (ratio(F.last("close_u").over(w), F.col("close_u")) - 1).alias("r"))


@query(
    f"""WITH RECURSIVE {SWEPT}, {NEAREST[len(MATCHED) + 1 :]}, b AS (SELECT 'drawn' AS route, s.tolerance, s.event_id, avg(f.r) AS ctrl FROM swept s JOIN after f ON f.symbol = s.symbol AND f.ts_ms = s.control_ms WHERE s.seed = 0 GROUP BY ALL),
 n AS (SELECT 'nearest' AS route, CAST(0.5 AS DOUBLE) AS tolerance, o.event_id, f.r AS ctrl FROM once o JOIN after f ON f.symbol = o.symbol AND f.ts_ms = o.control_ms),
 p AS (SELECT route, tolerance, real, ctrl FROM (SELECT * FROM b UNION ALL SELECT * FROM n) JOIN real_r USING (event_id) WHERE real IS NOT NULL AND ctrl IS NOT NULL)
 SELECT route, tolerance, count(*) AS n_pairs, round(avg(real), 6) AS real_mean, round(avg(ctrl), 6) AS control_mean, round(avg(real - ctrl), 6) AS mean_diff, round(avg(real - ctrl) - 1.96 * stddev_samp(real - ctrl) / sqrt(count(*)), 6) AS low, round(avg(real - ctrl) + 1.96 * stddev_samp(real - ctrl) / sqrt(count(*)), 6) AS high FROM p GROUP BY ALL"""
)
def route_ladder(spark, sf_dir):
    """STAT-15, 17, 19: the same difference by two routes: controls drawn at each rung, and nearest ones used once."""
    drawn = swept(spark, sf_dir, 1).select(F.lit("drawn").alias("route"), "tolerance", "event_id", F.inline("drawn")).select("route", "tolerance", "event_id", "r")
    near = nearest(spark, sf_dir).select(F.lit("nearest").alias("route"), F.lit(max(RUNGS)).alias("tolerance"), "event_id", "symbol", F.col("control_ms").alias("ts_ms"))
    control = drawn.unionByName(near.join(_after(spark, sf_dir), ["symbol", "ts_ms"]).select("route", "tolerance", "event_id", "r")).select("route", "tolerance", "event_id", F.lit("control").alias("arm"), F.col("r").alias("ret_end"))
    real = C.forward_outcomes(V.trades(spark, sf_dir).select("event_id", "symbol", "ts_ms"), hours(spark, sf_dir), 3 * DAY)
    paired = control.select("route", "tolerance", "event_id").distinct().join(real, "event_id").select("route", "tolerance", "event_id", F.lit("real").alias("arm"), "ret_end")
    out = C.paired_differences(control.unionByName(paired), ["route", "tolerance"], "ret_end").drop("sd_diff")
    return rounded(out, "real_mean", "control_mean", "mean_diff", "low", "high")
