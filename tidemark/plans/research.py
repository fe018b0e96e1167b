"""Registered queries of the feature and research operators; they join those of tidemark.plans.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import sessions as S
from tidemark.operators import events as E
from tidemark.operators import features as X
from tidemark.operators import rankings as R
from tidemark.operators import stats as A
from tidemark.operators import temporal as T
from tidemark.operators.bars import ratio
from tidemark.plans.queries import BARS, BOOKS, DAY, EVENTS, FLOW, HOUR, HOURS, LEDGER, RANKS, TICKS, TR, doubles, flow, hours, query, rounded, text_day
from tidemark.sources import views as V


@query(f"WITH {BOOKS}, s AS (SELECT book, sum(q) AS a FROM asks GROUP BY book), t AS (SELECT book, sum(q) AS b FROM bids GROUP BY book) SELECT b.book, 2 * 10000 * b.size AS spread_u, round((t.b - s.a) / CAST(t.b + s.a AS DOUBLE), 6) AS imbalance FROM books b JOIN s USING (book) JOIN t USING (book)")
def book_imbalance(spark, sf_dir):
    """SRC-10, SIM-13: spread and signed imbalance over all levels."""
    b, a = F.col("bids"), F.col("asks")
    return rounded(V.books(spark, sf_dir).select("book", (F.get(a, F.lit(0))["price_u"] - F.get(b, F.lit(0))["price_u"]).alias("spread_u"), X.imbalance(b, a).alias("imbalance")), "imbalance")


@query(f"WITH {HOURS} SELECT CAST(DATE '1970-01-01' + CAST((ts_ms - {HOUR}) // {DAY} AS INTEGER) AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-19' AS held_out, count(*) AS n FROM hours GROUP BY 1")
def holdout_split(spark, sf_dir):
    """FLT-01, 05, 18: bars kept and held out, by the date on which they begin."""
    held = S.session_date(S.bar_start_ms(F.col("ts_ms"), HOUR)).between("2024-01-10", "2024-01-19")
    return hours(spark, sf_dir).groupBy(held.alias("held_out")).agg(F.count("*").alias("n"))


@query(f"WITH {TICKS} SELECT CAST((ts_ms >= 1704844800000) AS INTEGER) + CAST((ts_ms >= 1705708800000) AS INTEGER) AS era, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM ticks GROUP BY 1")
def collector_eras(spark, sf_dir):
    """FLT-06, AGG-12: counts by era between boundaries."""
    return V.ticks(spark, sf_dir).groupBy(S.bucket(F.col("ts_ms"), (1704844800000, 1705708800000)).alias("era")).agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"))


@query(f"WITH {TICKS}, n AS (SELECT symbol, kind, count(*) AS n FROM ticks GROUP BY ALL), q AS (SELECT kind, quantile_cont(n, 0.9) AS q FROM n GROUP BY kind) SELECT n.kind, n.symbol, n.n FROM n JOIN q USING (kind) WHERE n.n >= q.q")
def top_decile_symbols(spark, sf_dir):
    """FLT-21, AGG-05: symbols at or above the 0.9 quantile of counts, by kind."""
    n = V.ticks(spark, sf_dir).groupBy("symbol", "kind").agg(F.count("*").alias("n"))
    q = n.groupBy("kind").agg(F.percentile("n", 0.9).alias("q"))
    return n.join(q, "kind").where("n >= q").select("kind", "symbol", "n")


@query(f"WITH {HOURS} SELECT symbol, ts_ms, min(close_u) OVER (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS low_u, count(*) OVER (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS n_open FROM hours")
def trailing_windows(spark, sf_dir):
    """WIN-11, 23, 27: trailing minimum with a closed, and count with an open left edge."""
    w = lambda **o: T.trailing("symbol", "ts_ms", DAY, **o)
    return hours(spark, sf_dir).select("symbol", "ts_ms", F.min("close_u").over(w()).alias("low_u"), F.count("*").over(w(open_left=True)).alias("n_open"))


@query(
    f"WITH {HOURS} SELECT symbol, ts_ms, count(*) OVER w AS n_ahead, CAST(max(high_u) OVER w AS DOUBLE) AS max_high_u, CAST(last_value(close_u) OVER w AS DOUBLE) AS end_u FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN 1 FOLLOWING AND {3 * DAY} FOLLOWING)"
)
def forward_probe(spark, sf_dir):
    """WIN-26, 29, 30, JOIN-22: what follows each bar within three days."""
    return doubles(X.forward_probe(hours(spark, sf_dir), 3 * DAY).select("symbol", "ts_ms", "n_ahead", "max_high_u", "end_u"), "max_high_u", "end_u")


@query(
    f"""WITH {HOURS}, d AS (SELECT symbol, (ts_ms - 1) // {DAY} AS d, arg_max(close_u, ts_ms) AS c FROM hours GROUP BY ALL), p AS (SELECT symbol, d, lag(c) OVER (PARTITION BY symbol ORDER BY d) AS prev FROM d) SELECT h.symbol, h.ts_ms, CAST(p.prev AS DOUBLE) AS prev_close_u FROM hours h JOIN p ON p.symbol = h.symbol AND p.d = (h.ts_ms - 1) // {DAY}"""
)
def prev_day_close(spark, sf_dir):
    """WIN-12: the last close of the symbol's day before."""
    bars = hours(spark, sf_dir).withColumn("d", F.floor((F.col("ts_ms") - 1) / DAY))
    last = bars.groupBy("symbol", "d").agg(F.max_by("close_u", "ts_ms").alias("c")).withColumn("prev_close_u", F.lag("c").over(Window.partitionBy("symbol").orderBy("d")))
    return doubles(bars.join(last.select("symbol", "d", "prev_close_u"), ["symbol", "d"]).select("symbol", "ts_ms", "prev_close_u"), "prev_close_u")


@query(
    f"""WITH {HOURS}, s AS (SELECT symbol, min(ts_ms) AS a, max(ts_ms) AS b FROM hours GROUP BY symbol), g AS (SELECT symbol, unnest(range(a, b + 1, {HOUR})) AS ts_ms FROM s), v AS (SELECT g.symbol, g.ts_ms, ln(1 + coalesce(h.vol_qu, 0)) AS x FROM g LEFT JOIN hours h ON g.symbol = h.symbol AND g.ts_ms = h.ts_ms),
 z AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)) SELECT symbol, min(ts_ms) AS cross_ms FROM z WHERE n >= 48 AND s > 0.0001 AND (x - m) / s >= 3 GROUP BY symbol"""
)
def volume_z_cross(spark, sf_dir):
    """WIN-15, FEAT-03: the first unusual hour on a dense grid (deviations of rounding size count as none)."""
    grid = T.dense_grid(hours(spark, sf_dir).select("symbol", "ts_ms", "vol_qu"), "symbol", "ts_ms", HOUR, ["vol_qu"])
    return X.first_z_cross(grid, "vol_qu", 48, 3.0)


@query(
    f"""WITH {TICKS}, d AS (SELECT symbol, ts_ms // {DAY} AS d, sum(price_u) AS v FROM ticks GROUP BY ALL), s AS (SELECT symbol, d, v / nullif(CAST(sum(v) OVER (PARTITION BY d) AS DOUBLE), 0) AS share FROM d)
 SELECT symbol, d, round(share, 6) AS share, round(CASE WHEN lag(d) OVER w = d - 1 THEN share - lag(share) OVER w END, 6) AS share_delta FROM s WINDOW w AS (PARTITION BY symbol ORDER BY d)"""
)
def market_shares(spark, sf_dir):
    """WIN-19: daily share of the market, and its change over adjacent days."""
    d = V.ticks(spark, sf_dir).groupBy("symbol", F.floor(F.col("ts_ms") / DAY).alias("d")).agg(F.sum("price_u").alias("v"))
    s = d.withColumn("share", ratio(F.col("v"), F.sum("v").over(Window.partitionBy("d"))))
    w = Window.partitionBy("symbol").orderBy("d")
    return rounded(s.withColumn("share_delta", F.when(F.lag("d").over(w) == F.col("d") - 1, F.col("share") - F.lag("share").over(w))).drop("v"), "share", "share_delta")


@query(
    f"""WITH {RANKS} SELECT ranking_type, symbol, snap_ms, round((last_value(rank) OVER w - first_value(rank) OVER w) / (CAST(snap_ms - min(snap_ms) OVER w AS DOUBLE) / {DAY}), 6) AS ranks_per_day FROM ranks WINDOW w AS (PARTITION BY ranking_type, symbol ORDER BY snap_ms RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW) QUALIFY snap_ms > min(snap_ms) OVER w"""
)
def rank_speed(spark, sf_dir):
    """WIN-32..34: change of rank per day over the last five days."""
    w = Window.partitionBy("ranking_type", "symbol").orderBy("snap_ms").rangeBetween(-5 * DAY, 0)
    out = V.rankings(spark, sf_dir).withColumn("t0", F.min("snap_ms").over(w)).withColumn("ranks_per_day", (F.last("rank").over(w) - F.first("rank").over(w)) / F.nullif((F.col("snap_ms") - F.col("t0")) / DAY, F.lit(0.0)))
    return rounded(out.where("snap_ms > t0").select("ranking_type", "symbol", "snap_ms", "ranks_per_day"), "ranks_per_day")


@query(
    f"""WITH {TICKS}, g AS (SELECT symbol, ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, event_id) AS gap, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC, event_id DESC) AS k FROM ticks),
 m AS (SELECT symbol, quantile_cont(gap, 0.5) FILTER (k <= 5) AS a, quantile_cont(gap, 0.5) FILTER (k > 5 AND k <= 20) AS b, count(*) FILTER (k > 5 AND k <= 20) AS n FROM g WHERE gap IS NOT NULL GROUP BY symbol) SELECT symbol, round(CASE WHEN n >= 15 AND b > 0 THEN a / b END, 6) AS ratio FROM m"""
)
def print_gap_ratio(spark, sf_dir):
    """WIN-36, 37, FEAT-05: event-time intensity of the last five prints against the fifteen before."""
    return rounded(X.print_gap_ratio(V.ticks(spark, sf_dir), 5, 15), "ratio")


@query(
    f"""WITH {TICKS}, m AS (SELECT *, max(price_u) OVER (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW) AS top, lag(price_u) OVER (PARTITION BY symbol ORDER BY ts_ms, event_id) AS prev FROM ticks), f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, event_id) AS k FROM m WHERE price_u <= top * (1 - 0.6) AND price_u > prev)
 SELECT symbol, ts_ms AS entry_ms, price_u FROM f WHERE k = 1"""
)
def oversold_entries(spark, sf_dir):
    """EVT-18, 19, 22: the first rebound after a deep fall."""
    return X.oversold_entries(V.ticks(spark, sf_dir), 0.6, 5 * DAY)


@query(
    f"""WITH {FLOW} SELECT CASE WHEN n < 2 THEN 0 WHEN n < 4 THEN 1 ELSE 2 END AS size, count(*) AS n_windows, round(quantile_cont(abs(ret_bp), 0.5), 4) AS median_move, round(quantile_cont(abs(ret_bp), 0.25), 4) AS p25, round(quantile_cont(abs(ret_bp), 0.75), 4) AS p75 FROM flow GROUP BY 1"""
)
def moves_by_size(spark, sf_dir):
    """AGG-25, FLT-16: medians of a measure by size bucket."""
    f = flow(spark, sf_dir).groupBy(S.bucket(F.col("n"), (2, 4)).alias("size"))
    move = F.abs("ret_bp")
    return rounded(f.agg(F.count("*").alias("n_windows"), F.percentile(move, 0.5).alias("median_move"), F.percentile(move, 0.25).alias("p25"), F.percentile(move, 0.75).alias("p75")), "median_move", "p25", "p75", digits=4)


@query(
    f"""WITH {TICKS}, m AS (SELECT symbol, quantile_cont(price_u, 0.5) FILTER (kind = 'purchase') AS l, quantile_cont(price_u, 0.5) FILTER (kind = 'view') AS r, count(*) FILTER (kind = 'purchase') AS a, count(*) FILTER (kind = 'view') AS b FROM ticks GROUP BY symbol) SELECT symbol, l AS "left", r AS "right", l - r AS delta FROM m WHERE a >= 3 AND b >= 3"""
)
def within_symbol_contrast(spark, sf_dir):
    """AGG-26, JOIN-07: medians of two strata of one symbol and their difference."""
    return X.contrast(V.ticks(spark, sf_dir), "symbol", "price_u", F.col("kind") == "purchase", F.col("kind") == "view", 3)


@query(f"WITH {TICKS} SELECT coalesce(kind, 'all') AS kind, coalesce(CAST(ts_ms // {7 * DAY} AS VARCHAR), 'all') AS week, count(*) AS n, CAST(sum(price_u) AS BIGINT) AS amount FROM ticks GROUP BY GROUPING SETS ((kind, ts_ms // {7 * DAY}), (kind), ())")
def event_cube(spark, sf_dir):
    """AGG-06, 07, 16: mergeable sums by cell, rolled up."""
    t = V.ticks(spark, sf_dir).withColumn("week", F.floor(F.col("ts_ms") / (7 * DAY)).cast("string"))
    out = t.groupingSets([[F.col("kind"), F.col("week")], [F.col("kind")], []], "kind", "week").agg(F.count("*").alias("n"), F.sum("price_u").alias("amount"))
    return out.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("week", F.lit("all")).alias("week"), "n", "amount")


@query(
    f"""WITH {EVENTS}, t AS (SELECT l.ret, b.n_days >= 20 AND (ln(b.vol) - b.log_mean) / nullif(b.log_std, 0) >= 1 AS truth FROM labelled l JOIN base b ON l.symbol = b.symbol AND l.day = b.day), v AS (SELECT CAST(q AS DOUBLE) AS threshold, ret >= q AS hit, coalesce(truth, false) AS truth FROM t, (VALUES (0.6), (1.0), (2.0)) x(q)),
 c AS (SELECT threshold, count(*) FILTER (hit AND truth) AS tp, count(*) FILTER (hit AND NOT truth) AS fp, count(*) FILTER (NOT hit AND truth) AS fn FROM v GROUP BY threshold) SELECT threshold, tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM c"""
)
def signal_confusion(spark, sf_dir):
    """FEAT-09: precision, recall and F1 of a threshold signal."""
    from tidemark.operators.baselines import daily_baseline, volume_z

    bars = V.candles_1d(spark, sf_dir)
    based = daily_baseline(bars).withColumn("truth", F.coalesce((F.col("n_days") >= 20) & (volume_z() >= 1), F.lit(False))).select("symbol", "day", "truth")
    ev = E.daily_events(bars, 0.5, 5).join(based, ["symbol", "day"])
    return rounded(X.confusion(ev, "ret", "truth", (0.6, 1.0, 2.0)), "precision", "recall", "f1")


@query(
    f"""WITH {EVENTS}, k AS (SELECT l.symbol, l.day, min(b.day) FILTER (b.low_u <= l.peak * 0.8) - l.day AS days_to_fall FROM labelled l JOIN bars b ON b.symbol = l.symbol AND b.day >= l.day AND b.day <= l.day + 30 GROUP BY l.symbol, l.day) SELECT count(*) AS n, count(days_to_fall) AS n_fell, round(quantile_cont(days_to_fall, 0.5), 6) AS median_days FROM k"""
)
def dump_speed(spark, sf_dir):
    """FEAT-12: days from an event to a fall of 20 % below its peak; what doesn't fall within the horizon is counted."""
    bars = V.candles_1d(spark, sf_dir).withColumn("ts_ms", F.unix_date("day").cast("long") * DAY)
    w = Window.partitionBy("symbol").orderBy("day")
    ev = bars.withColumn("prev", F.lag("close_u").over(w)).withColumn("peak", F.max("high_u").over(w.rowsBetween(0, 5))).where(F.col("high_u") >= F.col("prev") * 1.5)
    pairs = T.range_pairs(ev.select("symbol", "ts_ms", "peak"), bars.select("symbol", "ts_ms", "low_u"), "symbol", "ts_ms", -1, 30 * DAY)
    fell = pairs.groupBy("symbol", "ts_ms").agg(((T.first_hit(F.col("r_low_u") <= F.col("peak") * 0.8, "r_ts_ms") - F.col("ts_ms")) / DAY).alias("d"))
    return rounded(fell.agg(F.count("*").alias("n"), F.count("d").alias("n_fell"), F.percentile("d", 0.5).alias("median_days")), "median_days")


@query(
    f"""WITH {EVENTS}, e AS (SELECT quantile_cont(ret, 0.25) AS a, quantile_cont(ret, 0.5) AS b, quantile_cont(ret, 0.75) AS c FROM labelled) SELECT CAST(ret > a AS INTEGER) + CAST(ret > b AS INTEGER) + CAST(ret > c AS INTEGER) AS bucket, count(*) AS n, round(avg(ret_close), 6) AS gross, round(avg(ret_close) - 0.01, 6) AS net FROM labelled, e GROUP BY 1"""
)
def score_expectancy(spark, sf_dir):
    """FEAT-13, SIM-11, STAT-06: outcome by quartile of a score, gross and net of cost."""
    ev = A.bucketed(E.daily_events(V.candles_1d(spark, sf_dir), 0.5, 5), "ret", 4)
    return rounded(ev.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("ret_close").alias("gross"), (F.avg("ret_close") - 0.01).alias("net")), "gross", "net")


@query(
    f"""WITH {FLOW}, p AS (SELECT next_ret_bp, row_number() OVER (PARTITION BY start_ms ORDER BY imbalance, symbol) / CAST(count(*) OVER (PARTITION BY start_ms) AS DOUBLE) AS p FROM flow WHERE imbalance IS NOT NULL AND next_ret_bp IS NOT NULL)
 SELECT round(avg(next_ret_bp) FILTER (p > 0.9), 4) AS top_mean, round(avg(next_ret_bp) FILTER (p <= 0.1), 4) AS bottom_mean, round(avg(next_ret_bp) FILTER (p > 0.9) - avg(next_ret_bp) FILTER (p <= 0.1), 4) AS spread FROM p"""
)
def economic_significance(spark, sf_dir):
    """STAT-09: next returns of the top and bottom tenth by a signal within each period."""
    return rounded(X.within_period_spread(flow(spark, sf_dir), "start_ms", "imbalance", "next_ret_bp", 0.1), "top_mean", "bottom_mean", "spread", digits=4)


@query(
    f"""WITH {HOURS} SELECT t.event_id, t.symbol, count(h.ts_ms) AS n_pool FROM trades t LEFT JOIN hours h ON h.symbol = t.symbol AND abs(ln(nullif(h.close_u, 0) / nullif(CAST(t.price_u AS DOUBLE), 0))) <= ln(1.25) AND abs(h.ts_ms - t.ts_ms) > {DAY} GROUP BY ALL"""
)
def matched_pool_sizes(spark, sf_dir):
    """FLT-22, 24, STAT-16: how many control bars of the symbol match each event's price, away from it in time."""
    ev = V.trades(spark, sf_dir).select("event_id", "symbol", "ts_ms", F.col("price_u").alias("close_u"))
    return X.pool_sizes(ev, hours(spark, sf_dir), "close_u", 0.25, DAY).select("event_id", "symbol", "n_pool")


@query(f"WITH {TR} SELECT symbol, round(regr_slope(close_u, epoch(CAST(day AS TIMESTAMP)) / 86400), 4) AS slope, round(corr(vol, true_range_u), 6) AS corr FROM tr GROUP BY symbol")
def symbol_slopes(spark, sf_dir):
    """FN-03, FEAT-06: least-squares slope of closes over days."""
    from tidemark.operators.baselines import true_range

    bars = true_range(V.candles_1d(spark, sf_dir))
    return rounded(rounded(bars.groupBy("symbol").agg(F.regr_slope("close_u", F.unix_date("day")).alias("slope"), F.corr("vol", "true_range_u").alias("corr")), "slope", digits=4), "corr")


@query(
    f"""WITH {EVENTS} SELECT symbol, CAST(day AS VARCHAR) AS day, round(least(1.0, greatest(0.0, 0.6 * least(1.0, greatest(0.0, (ret - 0.5) / (3.0 - 0.5))) + 0.4 * least(1.0, greatest(0.0, (-drawdown - 0.1) / (0.9 - 0.1))))), 6) AS score FROM labelled"""
)
def event_scores(spark, sf_dir):
    """FEAT-08, FN-06: weighted ramps."""
    ev = E.daily_events(V.candles_1d(spark, sf_dir), 0.5, 5)
    score = X.weighted_score({"ret": (S.ramp(F.col("ret"), 0.5, 3.0), 0.6), "fall": (S.ramp(-F.col("drawdown"), 0.1, 0.9), 0.4)})
    return rounded(text_day(ev.withColumn("score", score)).select("symbol", "day", "score"), "score")


@query(
    f"""WITH {RANKS}, f AS (SELECT symbol, min(snap_ms) FILTER (ranking_type = 'events') AS a, min(snap_ms) FILTER (ranking_type = 'purchases') AS b FROM ranks WHERE rank <= 20 GROUP BY symbol) SELECT count(*) AS n, count(*) FILTER (a < b) AS n_lead, count(*) FILTER (a > b) AS n_lag, count(*) FILTER (a = b) AS n_same, count(*) FILTER (a IS NULL OR b IS NULL) AS n_one FROM f"""
)
def list_lead_lag(spark, sf_dir):
    """FEAT-10, WIN-14: which list a symbol enters first."""
    at = lambda t: F.min(F.when(F.col("ranking_type") == t, F.col("snap_ms")))
    f = R.best_rank(V.rankings(spark, sf_dir)).where("rank <= 20").groupBy("symbol").agg(at("events").alias("a"), at("purchases").alias("b"))
    return f.agg(F.count("*").alias("n"), F.expr("count_if(a < b)").alias("n_lead"), F.expr("count_if(a > b)").alias("n_lag"), F.expr("count_if(a = b)").alias("n_same"), F.expr("count_if(a is null or b is null)").alias("n_one"))


@query(
    f"""WITH {LEDGER}, v AS (SELECT *, lead(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, seq) AS nxt FROM ledger), e AS (SELECT symbol, ts_ms AS a, coalesce(nxt, 1009843200000) AS b FROM v WHERE to_tier = 3) SELECT symbol, count(*) AS n_episodes, CAST(sum(b - a) AS BIGINT) AS total_ms, max(b - a) AS longest_ms FROM e GROUP BY symbol"""
)
def tier_episodes(spark, sf_dir):
    """JOIN-23, AGG-15: episodes in a tier, opened and closed by the ledger."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", "seq")
    e = V.ledger(spark, sf_dir).withColumn("b", F.coalesce(F.lead("ts_ms").over(w), F.lit(1009843200000))).where("to_tier = 3").withColumn("d", F.col("b") - F.col("ts_ms"))
    return e.groupBy("symbol").agg(F.count("*").alias("n_episodes"), F.sum("d").alias("total_ms"), F.max("d").alias("longest_ms"))


@query(
    f"""WITH {TICKS} SELECT 'ticks' AS name, count(*) AS n, max(ts_ms) AS last_ms FROM ticks UNION ALL SELECT 'trades', count(*), max(ts_ms) FROM trades UNION ALL SELECT 'quotes', count(*), max(ts_ms) FROM quotes"""
)
def table_health(spark, sf_dir):
    """AGG-23, 31: rows and the newest time of each table."""
    out = None
    for name, df in (("ticks", V.ticks(spark, sf_dir)), ("trades", V.trades(spark, sf_dir)), ("quotes", V.quotes(spark, sf_dir))):
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.max("ts_ms").alias("last_ms"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p_partkey AS symbol, CAST(round(CAST(p_retailprice AS DECIMAL(18, 2)) * 1000000) AS BIGINT) AS price_u FROM part")
def decimal_text(spark, sf_dir):
    """FN-01: decimal texts in micro units."""
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), X.micro(F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("price_u"))
