"""Registered queries of signal exits, permutations and precursor features; they join those of tidemark.plans.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import exits as X
from tidemark.operators import features as C
from tidemark.operators.bars import ratio
from tidemark.plans.queries import DAY, HOUR, HOURS, NUDGE, RANKS, TICKS, hours, query
from tidemark.sources import views as V

RULES = {"rank_stall": ("stall", 2 * DAY), "rank_reverse": ("worsen", 20), "share_drop": ("drop", 0.5), "ask_thicken": ("rise", 2.0), "bid_vanish": ("drop", 0.5)}


def entries(spark, sf_dir):
    return V.trades(spark, sf_dir).select(F.col("event_id").alias("entry_id"), "symbol", F.col("ts_ms").alias("entry_ms"), F.col("price_u").cast("double").alias("entry_u"))


def with_gross(out, of):
    gross = F.round(ratio(F.col("exit_u"), F.col("entry_u")) - 1, 6)
    return out.join(of.select("entry_id", "entry_u"), "entry_id").select("entry_id", "rule", F.col("exit_ms").cast("double").alias("exit_ms"), gross.alias("gross"), "filled", "available")


LAST = f"px AS (SELECT symbol, ts_ms, last(price_u ORDER BY event_id) AS price_u FROM ticks GROUP BY ALL), asked AS (SELECT event_id AS entry_id, symbol, ts_ms AS entry_ms, ts_ms + {5 * DAY} AS end_ms, price_u AS entry_u FROM trades), ended AS (SELECT a.*, CASE WHEN p.ts_ms >= entry_ms THEN p.ts_ms END AS last_ms, CASE WHEN p.ts_ms >= entry_ms THEN p.price_u END AS last_u FROM asked a ASOF LEFT JOIN px p ON a.symbol = p.symbol AND a.end_ms >= p.ts_ms)"
DONE = "CAST(CASE WHEN ok THEN coalesce(hit, last_ms) END AS DOUBLE) AS exit_ms, round(CASE WHEN ok THEN coalesce(hit_u, last_u) END / nullif(CAST(entry_u AS DOUBLE), 0) - 1, 6) AS gross, ok AND hit IS NOT NULL AS filled, ok AS available"


@query(
    f"""WITH {RANKS}, {LAST}, shares AS (SELECT symbol, snap_ms AS ts_ms, CAST(rank AS DOUBLE) AS rank, amount / CAST(sum(amount) OVER (PARTITION BY snap_ms) AS DOUBLE) AS share FROM ranks WHERE ranking_type = 'events'), sizes AS (SELECT symbol, ts_ms, CAST(max(qty_u) AS DOUBLE) AS size FROM ticks WHERE kind = 'view' GROUP BY ALL),
 sig AS (SELECT 'rank_stall' AS rule, symbol, ts_ms, rank AS value FROM shares UNION ALL SELECT 'rank_reverse', symbol, ts_ms, rank FROM shares UNION ALL SELECT 'share_drop', symbol, ts_ms, share FROM shares UNION ALL SELECT 'ask_thicken', symbol, ts_ms, size FROM sizes UNION ALL SELECT 'bid_vanish', symbol, ts_ms, size FROM sizes),
 priced AS (SELECT s.*, p.price_u FROM sig s ASOF LEFT JOIN px p ON s.symbol = p.symbol AND s.ts_ms >= p.ts_ms), pairs AS (SELECT a.entry_id, s.rule, s.ts_ms, s.value, s.price_u, first(value) OVER w AS f, min(value) OVER b AS best, max(value) OVER b AS peak,
 min(CASE WHEN rule = 'rank_stall' THEN CAST(value AS BIGINT) * 10000000000000 + s.ts_ms END) OVER b % 10000000000000 AS best_ms FROM asked a JOIN priced s ON a.symbol = s.symbol AND s.ts_ms BETWEEN a.entry_ms AND a.end_ms WINDOW w AS (PARTITION BY entry_id, rule ORDER BY s.ts_ms), b AS (PARTITION BY entry_id, rule ORDER BY s.ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 fires AS (SELECT *, price_u IS NOT NULL AND CASE rule WHEN 'rank_stall' THEN value >= best AND ts_ms - best_ms >= {2 * DAY} WHEN 'rank_reverse' THEN value >= best + 20 WHEN 'ask_thicken' THEN peak IS NOT NULL AND value >= 2 * f ELSE peak > 0 AND value <= 0.5 * peak END AS fire FROM pairs),
 told AS (SELECT entry_id, rule, count(*) AS n, min(f) AS f, min(ts_ms) FILTER (fire) AS hit, arg_min(price_u, ts_ms) FILTER (fire) AS hit_u FROM fires GROUP BY ALL), every AS (SELECT e.*, r.rule FROM ended e, (SELECT unnest(['rank_stall', 'rank_reverse', 'share_drop', 'ask_thicken', 'bid_vanish']) AS rule) r),
 judged AS (SELECT v.*, t.hit, t.hit_u, coalesce(t.n >= 3 AND (v.rule <> 'ask_thicken' OR t.f > 0), false) AND coalesce(t.hit_u, v.last_u) IS NOT NULL AS ok FROM every v LEFT JOIN told t ON t.entry_id = v.entry_id AND t.rule = v.rule) SELECT entry_id, rule, {DONE} FROM judged"""
)
def signal_exits(spark, sf_dir):
    """SIM-06..08: entries by rules on ranks, shares and sizes, with what can't be judged told apart."""
    ranks = V.rankings(spark, sf_dir).where("ranking_type = 'events'").withColumn("share", F.col("amount") / F.sum("amount").over(Window.partitionBy("snap_ms")))
    sizes = V.ticks(spark, sf_dir).where("kind = 'view'").groupBy("symbol", "ts_ms").agg(F.max("qty_u").alias("size"))
    each = lambda **named: F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("double").alias("value")) for n, c in named.items()])).alias("s")
    of_ranks = ranks.select("symbol", F.col("snap_ms").alias("ts_ms"), each(rank_stall=F.col("rank"), rank_reverse=F.col("rank"), share_drop=F.col("share")))
    of_sizes = sizes.select("symbol", "ts_ms", each(ask_thicken=F.col("size"), bid_vanish=F.col("size")))
    of = entries(spark, sf_dir)
    return with_gross(X.signal_exits(V.ticks(spark, sf_dir), of_ranks.union(of_sizes).select("s.rule", "symbol", "ts_ms", "s.value"), of, RULES, horizon_ms=5 * DAY), of)


@query(
    f"""WITH {TICKS}, {LAST}, v AS (SELECT a.entry_id, (t.ts_ms - a.entry_ms) // {DAY} AS k, sum(t.qty_u) AS v, count(*) AS n FROM asked a JOIN ticks t ON a.symbol = t.symbol AND t.ts_ms BETWEEN a.entry_ms AND a.end_ms GROUP BY ALL), g AS (SELECT a.*, k FROM asked a, range(0, 5) r(k)),
 d AS (SELECT g.entry_id, g.symbol, g.entry_ms + (g.k + 1) * {DAY} AS t, coalesce(v.v, 0) AS v, max(coalesce(v.v, 0)) OVER (PARTITION BY g.entry_id ORDER BY g.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM g LEFT JOIN v ON v.entry_id = g.entry_id AND v.k = g.k), f AS (SELECT * FROM d WHERE peak > 0 AND v <= 0.5 * peak),
 h AS (SELECT f.entry_id, min(f.t) AS hit, arg_min(p.price_u, f.t) AS hit_u FROM f ASOF JOIN px p ON f.symbol = p.symbol AND f.t >= p.ts_ms GROUP BY f.entry_id), c AS (SELECT entry_id, sum(n) AS n FROM v GROUP BY entry_id),
 judged AS (SELECT e.*, h.hit, h.hit_u, coalesce(c.n >= 3, false) AND coalesce(h.hit_u, e.last_u) IS NOT NULL AS ok FROM ended e LEFT JOIN h USING (entry_id) LEFT JOIN c USING (entry_id)) SELECT entry_id, 'tape_fade' AS rule, {DONE} FROM judged"""
)
def tape_fade_exits(spark, sf_dir):
    """SIM-07: exits when a closed bucket's volume falls to half of the largest."""
    of, ticks = entries(spark, sf_dir), V.ticks(spark, sf_dir)
    return with_gross(X.tape_fade_exits(ticks, ticks, of, bucket_ms=DAY, share=0.5, horizon_ms=5 * DAY), of)


@query(
    f"""WITH {HOURS}, s AS (SELECT symbol, ts_ms, max(qty_u) AS value FROM ticks WHERE kind = 'view' GROUP BY ALL), b AS (SELECT h.symbol, h.ts_ms, h.high_u, h.low_u, h.close_u, s.value FROM hours h ASOF LEFT JOIN s ON h.symbol = s.symbol AND h.ts_ms >= s.ts_ms), e AS (SELECT event_id AS entry_id, symbol, ts_ms AS entry_ms, CAST(price_u AS DOUBLE) AS entry_u FROM trades),
 p AS (SELECT e.*, b.ts_ms, b.close_u, b.value, max(b.high_u) OVER w AS hi, min(b.low_u) OVER w AS lo FROM e JOIN b ON e.symbol = b.symbol AND b.ts_ms BETWEEN e.entry_ms AND e.entry_ms + {5 * DAY} WINDOW w AS (PARTITION BY entry_id ORDER BY b.ts_ms)),
 t AS (SELECT entry_id, min(ts_ms) FILTER (value >= 80000000) AS hit, max(ts_ms) AS last, count(value) AS n FROM p GROUP BY entry_id), x AS (SELECT p.*, t.hit, t.n FROM p JOIN t ON t.entry_id = p.entry_id AND p.ts_ms = coalesce(t.hit, t.last))
 SELECT e.entry_id, CAST(x.ts_ms AS DOUBLE) AS exit_ms, round(x.close_u / nullif(e.entry_u, 0) - 1, 6) AS gross, CASE WHEN x.hit IS NOT NULL THEN 'signal' WHEN x.ts_ms IS NOT NULL THEN 'horizon' ELSE 'no_path' END AS reason, round(greatest(x.hi, e.entry_u) / nullif(e.entry_u, 0) - 1, 6) AS mfe, round(least(x.lo, e.entry_u) / nullif(e.entry_u, 0) - 1, 6) AS mae, coalesce(x.n, 0) > 0 AS signal_defined FROM e LEFT JOIN x ON x.entry_id = e.entry_id"""
)
def threshold_exits(spark, sf_dir):
    """SIM-02: exits when the signal in force reaches a threshold."""
    signal = V.ticks(spark, sf_dir).where("kind = 'view'").groupBy("symbol", "ts_ms").agg(F.max("qty_u").alias("value"))
    out = X.threshold_exits(hours(spark, sf_dir), signal, entries(spark, sf_dir), threshold=80_000_000, above=True, horizon_ms=5 * DAY)
    r = lambda c: F.round(c, 6)
    return out.select("entry_id", F.col("exit_ms").cast("double").alias("exit_ms"), r(ratio(F.col("exit_u"), F.col("entry_u")) - 1).alias("gross"), "reason", r("mfe").alias("mfe"), r("mae").alias("mae"), "signal_defined")


@query(
    f"""WITH {TICKS}, m AS (SELECT symbol AS pair, quantile_cont(price_u, 0.5) FILTER (kind = 'purchase') AS l, quantile_cont(price_u, 0.5) FILTER (kind = 'view') AS r, count(*) FILTER (kind = 'purchase') AS a, count(*) FILTER (kind = 'view') AS b FROM ticks GROUP BY symbol), d AS (SELECT m.*, k, k > 0 AND md5(CAST(pair AS VARCHAR) || '-' || CAST(k AS VARCHAR)) < '8' AS s FROM m, range(0, 201) x(k) WHERE a >= 3 AND b >= 3),
 g AS (SELECT k, quantile_cont(CASE WHEN s THEN l ELSE r END, 0.5) - quantile_cont(CASE WHEN s THEN r ELSE l END, 0.5) AS gap, count(*) AS n FROM d GROUP BY k), o AS (SELECT gap AS observed_gap, n AS n_pairs FROM g WHERE k = 0) SELECT n_pairs, observed_gap, round((count(*) FILTER (abs(gap) >= abs(observed_gap)) + 1) / CAST(count(*) + 1 AS DOUBLE), 6) AS p_two_sided FROM g, o WHERE k > 0 GROUP BY ALL"""
)
def gap_permutation(spark, sf_dir):
    """STAT-13: within-pair exchange of a gap of medians."""
    pairs = C.contrast(V.ticks(spark, sf_dir), "symbol", "price_u", F.col("kind") == "purchase", F.col("kind") == "view", 3)
    out = X.gap_permutation(pairs.select(F.col("symbol").alias("pair"), F.col("left").alias("real"), F.col("right").alias("placebo")), 200)
    return out.withColumn("p_two_sided", F.round("p_two_sided", 6))


WINDOWS, BASE = (5, 15, 30, 60), 240


def _atr(near: int, far: int) -> str:
    inside = f"age >= {near} AND age < {far}"
    return f"(CASE WHEN count(*) FILTER ({inside}) >= 2 THEN sum(CASE WHEN p_ms > cutoff_ms - {far * HOUR} THEN reach ELSE span END) FILTER ({inside}) / CAST(count(*) FILTER ({inside}) AS DOUBLE) / nullif(any_value(close_cut), 0) END)"


def _sd(w: int) -> str:
    x, b = f"coalesce(sum(x) FILTER (age >= {w} AND age < {w + BASE}), 0)", f"coalesce(sum(x * x) FILTER (age >= {w} AND age < {w + BASE}), 0)"
    variance = f"(({b} - {x} * {x} / {BASE}) / {BASE - 1})"
    return f"(CASE WHEN {variance} > 1e-9 THEN sqrt({variance}) END)"


def _wide(w: int) -> str:
    return f"((max(high_u) FILTER (age < {w}) - min(low_u) FILTER (age < {w})) / nullif(CAST(any_value(close_cut) AS DOUBLE), 0))"


def _mean(w: int) -> str:
    return f"coalesce(sum(x) FILTER (age >= {w} AND age < {w + BASE}), 0) / {BASE}"


PRECURSOR = {"cutoff_ms": "CAST(any_value(cutoff_ms) AS DOUBLE)", "n_bars_pre": "coalesce(any_value(n), 0)"}
for _w in WINDOWS:
    PRECURSOR |= {
        f"vol_sum_{_w}": f"CAST(sum(vol_qu) FILTER (age < {_w}) AS DOUBLE)", f"vol_z_{_w}": f"(sum(x) FILTER (age < {_w}) / {_w} - {_mean(_w)}) / {_sd(_w)}",
        f"vol_ratio_{_w}": f"(sum(vol_qu) FILTER (age < {_w}) / {_w}.0) / (nullif(sum(vol_qu) FILTER (age >= {_w} AND age < {_w + BASE}), 0) / {BASE}.0)",
        f"ret_{_w}": f"any_value(close_cut) / nullif(CAST(arg_min(close_u, ts_ms) FILTER (age < {_w}) AS DOUBLE), 0) - 1", f"atr_pct_{_w}": _atr(0, _w), f"range_pct_{_w}": _wide(_w), f"no_print_ratio_{_w}": f"CASE WHEN any_value(n) > 0 THEN 1 - count(*) FILTER (age < {_w} AND vol_qu > 0) / {_w}.0 END",
    }
PRECURSOR |= {
    "vol_slope_30": "sum((14.5 - age) * x) FILTER (age < 30) / 2247.5", "vol_bar_z_max_60": f"(max(x) FILTER (age < 60) - {_mean(60)}) / {_sd(60)}", "coil_score": f"CASE WHEN {_atr(0, 15)} > 0 AND {_atr(15, 60)} > 0 THEN ln({_atr(15, 60)} / {_atr(0, 15)}) END", "nr_ratio": f"{_wide(15)} / nullif({_wide(60)}, 0)",
    "dist_from_vwap": "any_value(close_cut) / nullif(CAST(any_value(vwap_cut) AS DOUBLE), 0) - 1", "dist_from_hod": "any_value(close_cut) / nullif(CAST(any_value(hod_u) AS DOUBLE), 0) - 1", "up_bar_ratio_30": "avg(CAST(close_u > open_u AS INTEGER)) FILTER (age < 30 AND day = day_cut)", "new_high_count_30": "CAST(CASE WHEN any_value(n) > 0 THEN count(*) FILTER (age < 30 AND day = day_cut AND fresh) END AS DOUBLE)",
    "steps_since_last_print": f"CASE WHEN any_value(n) > 0 THEN coalesce((any_value(cutoff_ms) - any_value(prev_cut)) / {HOUR}.0 - 1, 0) END", "session_print_age": f"(any_value(cutoff_ms) - any_value(first_cut)) / {HOUR}.0", "session_first_print_lead": f"(any_value(first_cut) - {HOUR} - any_value(day_cut) * {DAY}) / {HOUR}.0",
}


@query(
    f"""WITH {HOURS}, a AS (SELECT symbol, ts_ms, open_u, high_u, low_u, close_u, vol_qu, (ts_ms - {HOUR}) // {DAY} AS day, ln(1 + vol_qu) AS x, (high_u + low_u + close_u) // 3 AS tp, high_u - low_u AS span FROM hours),
 k AS (SELECT *, row_number() OVER o AS n, lag(close_u) OVER o AS p_u, lag(ts_ms) OVER o AS p_ms, min(ts_ms) OVER d AS first_ms, max(high_u) OVER d AS hod_u, CAST(CASE WHEN sum(vol_qu) OVER d > 0 THEN sum(CAST(tp AS HUGEINT) * vol_qu) OVER d // sum(vol_qu) OVER d ELSE tp END AS BIGINT) AS vwap_u,
 high_u > coalesce(max(high_u) OVER (PARTITION BY symbol, day ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh FROM a WINDOW o AS (PARTITION BY symbol ORDER BY ts_ms), d AS (PARTITION BY symbol, day ORDER BY ts_ms)), r AS (SELECT *, greatest(span, abs(high_u - p_u), abs(low_u - p_u)) AS reach FROM k),
 c AS (SELECT t.event_id, t.symbol, k.ts_ms AS cutoff_ms, k.n, k.close_u AS close_cut, k.p_ms AS prev_cut, k.first_ms AS first_cut, k.hod_u, k.vwap_u AS vwap_cut, k.day AS day_cut FROM trades t ASOF LEFT JOIN k ON t.symbol = k.symbol AND t.ts_ms >= k.ts_ms),
 j AS (SELECT c.*, (c.cutoff_ms - r.ts_ms) / {HOUR}.0 AS age, r.* EXCLUDE (symbol, n, first_ms, hod_u, vwap_u) FROM c LEFT JOIN r ON c.symbol = r.symbol AND r.ts_ms > c.cutoff_ms - {300 * HOUR} AND r.ts_ms <= c.cutoff_ms)
 SELECT event_id, symbol, """
    + ", ".join(f"{e} AS {name}" if name == "n_bars_pre" else f"round(({e}) * {NUDGE}, 4) AS {name}" for name, e in PRECURSOR.items())
    + " FROM j GROUP BY event_id, symbol"
)
def precursor_features(spark, sf_dir):
    """FEAT-01, 03..05: what preceded each trade, in hourly steps."""
    out = X.precursor_features(V.trades(spark, sf_dir), hours(spark, sf_dir).drop("vwap_u"), step_ms=HOUR, day_ms=DAY, windows=WINDOWS, base=BASE)
    return out.select("event_id", "symbol", "n_bars_pre", *[F.round(F.col(c).cast("double") * NUDGE, 4).alias(c) for c in out.columns if c not in ("event_id", "symbol", "n_bars_pre")])
