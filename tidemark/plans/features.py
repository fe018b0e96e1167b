"""Registered queries of feature joins, audits, stream twins and scalar functions; they join those of tidemark.plans.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import sessions as S
from tidemark.operators import baselines as L
from tidemark.operators import execution as X
from tidemark.operators import temporal as T
from tidemark.operators.bars import ratio, tick_rule
from tidemark.plans.exits import LAST, entries
from tidemark.plans.queries import BARS, BOOKS, DAY, EVENTS, HOUR, HOURS, LEDGER, RANKS, TICKS, TR, doubles, hours, query, rounded, text_day
from tidemark.sources import store
from tidemark.sources import views as V

SESSION_SQL = """CASE WHEN m >= 540 AND m < 1020 THEN 'day' WHEN m >= 1020 AND m < 1350 THEN 'pre' WHEN m >= 1350 OR m < 300 THEN 'regular' WHEN m >= 300 AND m < 530 THEN 'after' ELSE 'closed' END"""


# Scans and stores


@query(f"WITH {BARS} SELECT symbol, CAST(day AS VARCHAR) AS day, open_u, close_u FROM bars WHERE day BETWEEN DATE '1995-03-01' AND DATE '1995-03-31' AND high_u >= 2 * low_u")
def read_events(spark, sf_dir):
    """SRC-03, 24: event days of one month, in order of time."""
    found = V.candles_1d(spark, sf_dir).where("day between date'1995-03-01' and date'1995-03-31' and high_u >= 2 * low_u").orderBy("day", "symbol")
    return text_day(found).select("symbol", "day", "open_u", "close_u")


@query(f"WITH {LEDGER}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC, seq DESC) AS r FROM ledger) SELECT symbol, to_tier AS tier FROM k WHERE r = 1 AND to_tier >= 2")
def symbols_in_tier(spark, sf_dir):
    """SRC-04: symbols whose tier is now 2 or more."""
    return store.last_wins(V.ledger(spark, sf_dir), ["symbol"], ["ts_ms", "seq"]).where("to_tier >= 2").select("symbol", F.col("to_tier").alias("tier"))


@query(
    f"""WITH {RANKS}, p AS (SELECT snap_ms, ranking_type, rank, symbol, amount FROM ranks WHERE rank <= 30 UNION ALL SELECT snap_ms, ranking_type, rank + 1, symbol, amount FROM ranks WHERE rank <= 15),
 d AS (SELECT ranking_type, snap_ms, rank, arg_max(symbol, amount * 1000000::HUGEINT + symbol) AS symbol FROM p GROUP BY ALL) SELECT ranking_type, snap_ms, CAST(rank AS INTEGER) AS rank, symbol FROM d"""
)
def insert_rankings(spark, sf_dir):
    """SRC-08: pages of ranks that overlap, stored as one symbol for each list, snapshot and rank: the larger amount's."""
    ranks = V.rankings(spark, sf_dir)
    pages = ranks.where("rank <= 30").unionByName(ranks.where("rank <= 15").withColumn("rank", F.col("rank") + 1))
    return store.last_wins(pages, ["ranking_type", "snap_ms", "rank"], ["amount", "symbol"]).select("ranking_type", "snap_ms", "rank", "symbol")


@query(
    f"""WITH {LEDGER}, g AS (SELECT *, lag(to_tier) OVER (PARTITION BY symbol ORDER BY ts_ms, seq) AS from_tier FROM ledger) SELECT symbol, seq, ts_ms, CAST(coalesce(from_tier, 1) AS INTEGER) AS from_tier, CAST(to_tier AS INTEGER) AS to_tier,
 CASE WHEN to_tier > coalesce(from_tier, 1) THEN 'promoted' ELSE 'demoted' END AS reason FROM g WHERE to_tier <> coalesce(from_tier, 1)"""
)
def promotions(spark, sf_dir):
    """SRC-11: ledger rows for changes of tier, with where they came from and why."""
    before = F.coalesce(F.lag("to_tier").over(Window.partitionBy("symbol").orderBy("ts_ms", "seq")), F.lit(1))
    moved = V.ledger(spark, sf_dir).withColumn("from_tier", before).where("to_tier <> from_tier")
    return moved.select("symbol", "seq", "ts_ms", "from_tier", "to_tier", F.when(F.col("to_tier") > F.col("from_tier"), "promoted").otherwise("demoted").alias("reason"))


@query(f"WITH {BARS}, m AS (SELECT DISTINCT symbol FROM bars WHERE high_u >= open_u * 4) SELECT s_suppkey AS symbol, s_suppkey IN (SELECT symbol FROM m) AS former_runner FROM supplier")
def former_runner_flags(spark, sf_dir):
    """SRC-07: a flag that is true for exactly the symbols found."""
    every = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return store.replace_flags(every, "symbol", V.candles_1d(spark, sf_dir).where("high_u >= open_u * 4"), "former_runner")


@query(f"""WITH {TICKS} SELECT CASE WHEN ts_ms < 1704844800000 THEN CAST(CAST(epoch_ms(ts_ms) AS DATE) AS VARCHAR) ELSE 'kept' END AS part, count(*) AS n, max(ts_ms) AS last_ms FROM trades GROUP BY 1""")
def archive_parts(spark, sf_dir):
    """SRC-13: what an archive by UTC date takes, and what stays."""
    date = F.to_date(F.timestamp_millis(F.col("ts_ms"))).cast("string")
    part = F.when(F.col("ts_ms") < 1704844800000, date).otherwise("kept")
    return V.trades(spark, sf_dir).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ms"))


# Filters and grids


@query(
    """WITH s AS (SELECT p_partkey AS symbol, p_retailprice AS px, CASE WHEN p_size > 45 THEN NULL WHEN p_size < 3 THEN 0 ELSE p_size END AS shares FROM part) SELECT symbol, CASE WHEN shares IS NULL THEN 'not_in_universe' WHEN shares <= 0 THEN 'no_shares'
 WHEN NOT (shares * px BETWEEN 10000 AND 40000) THEN 'cap_out' WHEN px >= 1000 AND px < 1400 THEN 'target' ELSE 'other_price' END AS stratum FROM s"""
)
def symbol_strata(spark, sf_dir):
    """FLT-15: strata by price and value of the whole; unknown shares are told, not guessed."""
    part = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("px"), F.expr("case when p_size > 45 then null when p_size < 3 then 0 else p_size end").alias("shares"))
    cap = F.col("shares") * F.col("px")
    target = (F.col("px") >= 1000) & (F.col("px") < 1400)
    stratum = F.when(F.col("shares").isNull(), "not_in_universe").when(F.col("shares") <= 0, "no_shares").when(~cap.between(10_000, 40_000), "cap_out").when(target, "target").otherwise("other_price")
    return part.select("symbol", stratum.alias("stratum"))


GRID = (
    HOURS
    + f""", gb AS (SELECT symbol, ts_ms, close_u / 1000000.0 AS px, ({HOUR} * 9 + ts_ms - {HOUR}) // 60000 % 1440 AS m, close_u / nullif(CAST(open_u AS DOUBLE), 0) - 1 AS slope, ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS gap FROM hours),
 gs AS (SELECT *, {SESSION_SQL} AS session FROM gb), gt AS (SELECT quantile_cont(slope, 0.5) AS med, quantile_cont(slope, 0.75) AS q75 FROM gs)"""
)
UNIVERSES = {"all": "true", "dollars": "px >= 20 and px < 100", "regular": "session = 'regular'", "dollars_regular": "px >= 20 and px < 100 and session = 'regular'"}
ENTRIES = {"any": "true", "slope_med": "slope >= med", "slope_q75": "slope >= q75", "not_day": "session <> 'day'", "halt": f"gap >= {6 * HOUR}", "halt_slope": f"gap >= {6 * HOUR} and slope >= med"}


@query(
    " UNION ALL ".join(f"SELECT '{u}' AS universe, '{e}' AS entry, count(*) FILTER (({p}) AND coalesce({q}, false)) AS n FROM gs, gt" for u, p in UNIVERSES.items() for e, q in ENTRIES.items()).join((f"WITH {GRID} ", ""))
)
def rule_grid(spark, sf_dir):
    """FLT-25, SIM-08: how many bars each pair of a universe and an entry rule lets through."""
    start = F.col("ts_ms") - HOUR
    bars = hours(spark, sf_dir).select(
        (F.col("close_u") / 1e6).alias("px"), S.session_of(start).alias("session"), (ratio(F.col("close_u"), F.col("open_u")) - 1).alias("slope"), (F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("symbol").orderBy("ts_ms"))).alias("gap")
    )
    cuts = bars.agg(F.percentile("slope", 0.5).alias("med"), F.percentile("slope", 0.75).alias("q75"))
    masks = F.array(*[F.struct(F.lit(u).alias("universe"), F.lit(e).alias("entry"), (F.expr(p) & F.coalesce(F.expr(q), F.lit(False))).cast("int").alias("hit")) for u, p in UNIVERSES.items() for e, q in ENTRIES.items()])
    return bars.crossJoin(F.broadcast(cuts)).select(F.inline(masks)).groupBy("universe", "entry").agg(F.sum("hit").alias("n"))


@query(f"""WITH {EVENTS} SELECT l.symbol, CAST(l.day AS VARCHAR) AS day, l.outcome, CAST(b.adv AS DOUBLE) AS adv, round(b.vol_mean, 6) AS vol_mean FROM labelled l LEFT JOIN base b ON l.symbol = b.symbol AND l.day = b.day AND b.n_days >= 5""")
def events_with_features(spark, sf_dir):
    """JOIN-01: events with the features of their day; what isn't there is null, and no column comes twice."""
    from tidemark.operators.events import daily_events

    bars = V.candles_1d(spark, sf_dir)
    ev, feats = daily_events(bars, 0.5, 5), L.daily_baseline(bars).where("n_days >= 5")
    again = [c for c in feats.columns if c in ev.columns and c not in ("symbol", "day")]
    out = ev.join(feats.drop(*again), ["symbol", "day"], "left").select("symbol", "day", "outcome", "adv", "vol_mean")
    return rounded(doubles(text_day(out), "adv"), "vol_mean")


@query(f"""WITH {TICKS} SELECT coalesce(c.c_mktsegment, 'no match') AS stratum, count(*) AS n, count(DISTINCT t.symbol) AS n_symbols FROM trades t LEFT JOIN customer c ON c.c_custkey = t.symbol GROUP BY 1""")
def attach_strata(spark, sf_dir):
    """JOIN-04: rows with their symbol's stratum; what has none is counted, so that a check can insist on zero."""
    tags = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("stratum"))
    out = V.trades(spark, sf_dir).join(tags, "symbol", "left").groupBy(F.coalesce("stratum", F.lit("no match")).alias("stratum"))
    return out.agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"))


WINDOW_HOURS = (6, 12, 18, 24, 30, 48)


@query(
    f"""WITH {RANKS}, r AS (SELECT symbol, snap_ms + {DAY} AS t, amount FROM ranks WHERE ranking_type = 'events' AND rank <= 20), w AS (SELECT r.symbol, r.t, r.amount, v.w, sum(k.price_u) AS s FROM r, (VALUES {", ".join(f"({w})" for w in WINDOW_HOURS)}) v(w)
 JOIN ticks k ON k.symbol = r.symbol AND k.ts_ms > r.t - v.w * {HOUR} AND k.ts_ms <= r.t GROUP BY ALL), m AS (SELECT w, count(*) AS n, quantile_cont(amount / nullif(CAST(s AS DOUBLE), 0), 0.5) AS q FROM w GROUP BY w)
 SELECT CAST(w AS INTEGER) AS window_h, n, round(q, 6) AS median_ratio, row_number() OVER (ORDER BY abs(q - 1), w) = 1 AS best FROM m"""
)
def window_estimate(spark, sf_dir):
    """JOIN-17: over how many hours of prints a ranking's amount is summed: the window whose ratio is nearest one."""
    ranks = V.rankings(spark, sf_dir).where("ranking_type = 'events' and rank <= 20").select("symbol", (F.col("snap_ms") + DAY).alias("ts_ms"), "amount")
    pairs = T.range_pairs(ranks, V.ticks(spark, sf_dir).select("symbol", "ts_ms", "price_u"), "symbol", "ts_ms", -max(WINDOW_HOURS) * HOUR, 0)
    each = pairs.withColumn("window_h", F.explode(F.array(*map(F.lit, WINDOW_HOURS)))).where(F.col("r_ts_ms") > F.col("ts_ms") - F.col("window_h") * HOUR)
    sums = each.groupBy("symbol", "ts_ms", "amount", "window_h").agg(F.sum("r_price_u").alias("s"))
    out = sums.groupBy("window_h").agg(F.count("*").alias("n"), F.percentile(ratio(F.col("amount"), F.col("s")), 0.5).alias("median_ratio"))
    best = F.row_number().over(Window.orderBy(F.abs(F.col("median_ratio") - 1), "window_h")) == 1  # one row a candidate
    return rounded(out.withColumn("best", best), "median_ratio")


@query(
    f"""WITH {TICKS}, px AS (SELECT symbol, ts_ms, last(price_u ORDER BY event_id) AS price_u FROM ticks GROUP BY ALL), q AS (SELECT t.symbol, t.price_u, CAST(v.d AS INTEGER) AS d, t.ts_ms - v.d * {HOUR} AS at_ms FROM trades t, (VALUES (0), (1), (6), (24)) v(d)),
 n AS (SELECT q.d, q.price_u, CASE WHEN q.at_ms - p.ts_ms <= {5 * DAY} THEN p.price_u END AS then_u FROM q ASOF LEFT JOIN px p ON q.symbol = p.symbol AND q.at_ms >= p.ts_ms) SELECT d AS lag_h, count(then_u) AS n, round(avg(CASE WHEN price_u = then_u THEN 1.0 ELSE 0.0 END) FILTER (then_u IS NOT NULL), 6) AS share_equal FROM n GROUP BY d"""
)
def price_age(spark, sf_dir):
    """JOIN-20: how often a price is that of the tape some hours before, which tells its age."""
    asked = V.trades(spark, sf_dir).select("symbol", "ts_ms", F.col("price_u").alias("shown_u"), F.explode(F.array(*map(F.lit, (0, 1, 6, 24)))).alias("lag_h")).withColumn("ts_ms", F.col("ts_ms") - F.col("lag_h") * HOUR)
    near = T.asof_join(asked, V.ticks(spark, sf_dir), "symbol", "ts_ms", ["price_u"], tolerance_ms=5 * DAY, tie="event_id")
    return rounded(near.groupBy("lag_h").agg(F.count("price_u").alias("n"), F.avg((F.col("shown_u") == F.col("price_u")).cast("double")).alias("share_equal")), "share_equal")


@query(
    f"""WITH {TICKS}, s AS (SELECT *, {SESSION_SQL} AS session FROM (SELECT *, (ts_ms + 32400000) // 60000 % 1440 AS m FROM ticks)), c AS (SELECT session, symbol, max(price_u) / nullif(CAST(min(price_u) AS DOUBLE), 0) - 1 AS r FROM s GROUP BY ALL)
 SELECT session, CAST(v.t AS DOUBLE) AS threshold, count(*) AS n, count(*) FILTER (r >= v.t) AS n_over, round(quantile_cont(r, 0.5) FILTER (r >= v.t), 6) AS median_over FROM c, (VALUES (0.5), (1.0), (3.0)) v(t) GROUP BY ALL"""
)
def session_breakdown(spark, sf_dir):
    """AGG-14: a table repeated by session, and whether a definition's threshold changes it."""
    c = V.ticks(spark, sf_dir).groupBy(S.session_of(F.col("ts_ms")).alias("session"), "symbol").agg((ratio(F.max("price_u"), F.min("price_u")) - 1).alias("r"))
    each = c.withColumn("threshold", F.explode(F.array(*map(F.lit, (0.5, 1.0, 3.0)))))
    over = F.col("r") >= F.col("threshold")
    return rounded(each.groupBy("session", "threshold").agg(F.count("*").alias("n"), F.count_if(over).alias("n_over"), F.percentile(F.when(over, F.col("r")), 0.5).alias("median_over")), "median_over")


@query(
    f"""WITH {RANKS}, b AS (SELECT symbol, count(DISTINCT ranking_type) = 2 AS in_both FROM ranks WHERE rank <= 50 GROUP BY symbol), g AS (SELECT symbol, snap_ms - lag(snap_ms) OVER (PARTITION BY symbol ORDER BY snap_ms) AS gap FROM (SELECT DISTINCT symbol, snap_ms FROM ranks WHERE rank <= 50))
 SELECT in_both, count(DISTINCT symbol) AS n_symbols, count(gap) AS n_gaps, round(avg(gap), 2) AS mean_gap_ms, round(quantile_cont(gap, 0.9), 2) AS p90_gap_ms FROM g JOIN b USING (symbol) GROUP BY in_both"""
)
def ranking_stream_shape(spark, sf_dir):
    """AGG-24: how often symbols are updated, those in both lists apart from the rest."""
    top = V.rankings(spark, sf_dir).where("rank <= 50")
    both = top.groupBy("symbol").agg((F.countDistinct("ranking_type") == 2).alias("in_both"))
    gaps = top.select("symbol", "snap_ms").distinct().withColumn("gap", F.col("snap_ms") - F.lag("snap_ms").over(Window.partitionBy("symbol").orderBy("snap_ms")))
    out = gaps.join(both, "symbol").groupBy("in_both").agg(F.countDistinct("symbol").alias("n_symbols"), F.count("gap").alias("n_gaps"), F.avg("gap").alias("mean_gap_ms"), F.percentile("gap", 0.9).alias("p90_gap_ms"))
    return rounded(out, "mean_gap_ms", "p90_gap_ms", digits=2)


# Windows


@query(
    f"""WITH {HOURS} SELECT symbol, ts_ms, round(sqrt(sum(pow(CASE WHEN low_u > 0 THEN ln(high_u / CAST(low_u AS DOUBLE)) END, 2)) OVER w), 6) AS range_vol, CAST(sum(vol_qu) OVER w AS BIGINT) AS vol, count(*) OVER w AS n FROM hours
 WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {12 * HOUR - 1} PRECEDING AND CURRENT ROW)"""
)
def candle_keys(spark, sf_dir):
    """WIN-24: range volatility, volume and number of the bars whose labels lie in the last twelve hours."""
    w = T.trailing("symbol", "ts_ms", 12 * HOUR, open_left=True)
    span = F.when(F.col("low_u") > 0, F.log(F.col("high_u") / F.col("low_u")))
    out = hours(spark, sf_dir).select("symbol", "ts_ms", F.sqrt(F.sum(span * span).over(w)).alias("range_vol"), F.sum("vol_qu").over(w).alias("vol"), F.count("*").over(w).alias("n"))
    return rounded(out, "range_vol")


@query(
    f"""WITH {TICKS}, q AS (SELECT symbol, ts_ms, CASE WHEN mid_u > 0 AND lag(mid_u) OVER w > 0 THEN ln(mid_u / CAST(lag(mid_u) OVER w AS DOUBLE)) END AS r FROM quotes WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, event_id))
 SELECT t.symbol, t.event_id, count(q.r) AS n, round(CASE WHEN count(q.r) >= 2 THEN stddev_samp(q.r) END, 6) AS vol FROM trades t LEFT JOIN q ON q.symbol = t.symbol AND q.ts_ms > t.ts_ms - {7 * DAY} AND q.ts_ms <= t.ts_ms GROUP BY ALL"""
)
def pre_trade_volatility(spark, sf_dir):
    """WIN-25: deviation of the mid's log changes in the week before each trade."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", "event_id")
    mid, prev = F.col("mid_u"), F.lag("mid_u").over(w)
    changes = V.quotes(spark, sf_dir).withColumn("r", F.when((mid > 0) & (prev > 0), F.log(mid / prev))).select("symbol", "ts_ms", "r")
    trades = V.trades(spark, sf_dir).select("symbol", "event_id", "ts_ms")
    seen = T.range_pairs(trades, changes, "symbol", "ts_ms", -7 * DAY, 0).groupBy("event_id").agg(F.count("r_r").alias("n"), F.stddev_samp("r_r").alias("vol"))
    out = trades.join(seen, "event_id", "left").select("symbol", "event_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= 2, F.col("vol")).alias("vol"))
    return rounded(out, "vol")


EVALS = tuple(range(1705104000000, 1706054400000, DAY))


@query(
    f"""WITH {TICKS}, e AS (SELECT unnest([{", ".join(map(str, EVALS))}]) AS at_ms), a AS (SELECT e.at_ms, t.symbol, coalesce(sum(price_u) FILTER (ts_ms >= at_ms - {5 * DAY}), 0) AS a, coalesce(sum(price_u) FILTER (ts_ms < at_ms - {5 * DAY}), 0) AS b FROM e JOIN ticks t ON t.ts_ms >= at_ms - {10 * DAY} AND t.ts_ms < at_ms GROUP BY ALL),
 s AS (SELECT at_ms, symbol, a / CAST(sum(a) OVER (PARTITION BY at_ms) AS DOUBLE) - b / CAST(sum(b) OVER (PARTITION BY at_ms) AS DOUBLE) AS d FROM a), p AS (SELECT *, rank() OVER (PARTITION BY at_ms ORDER BY d) / CAST(count(*) OVER (PARTITION BY at_ms) AS DOUBLE) AS pct FROM s)
 SELECT symbol, min(at_ms) FILTER (pct >= 0.9) AS first_cross_ms, round(max(pct), 6) AS top_pct, count(*) AS n_evals FROM p GROUP BY symbol HAVING max(pct) >= 0.9"""
)
def rotation_series(spark, sf_dir):
    """WIN-38: scores of rotation on a grid of times, and when a symbol first crosses the threshold."""
    ticks = V.ticks(spark, sf_dir).where(F.col("ts_ms").between(EVALS[0] - 10 * DAY, EVALS[-1] - 1))
    age = lambda e: (F.col("ts_ms") >= e - 10 * DAY) & (F.col("ts_ms") < e)
    each = ticks.withColumn("at_ms", F.explode(F.filter(F.array(*[F.lit(e).cast("long") for e in EVALS]), age)))
    late = F.col("ts_ms") >= F.col("at_ms") - 5 * DAY
    sums = each.groupBy("at_ms", "symbol").agg(F.sum(F.when(late, F.col("price_u")).otherwise(0)).alias("a"), F.sum(F.when(late, 0).otherwise(F.col("price_u"))).alias("b"))
    w = Window.partitionBy("at_ms")  # one row a symbol
    scored = sums.withColumn("d", ratio(F.col("a"), F.sum("a").over(w)) - ratio(F.col("b"), F.sum("b").over(w))).withColumn("pct", F.rank().over(w.orderBy("d")) / F.count("*").over(w))
    crossed = F.min(F.when(F.col("pct") >= 0.9, F.col("at_ms"))).alias("first_cross_ms")
    return rounded(scored.groupBy("symbol").agg(crossed, F.max("pct").alias("top_pct"), F.count("*").alias("n_evals")).where("first_cross_ms is not null"), "top_pct")


SPREADS = (
    TICKS
    + f""", q AS (SELECT symbol, ts_ms, last(mid_u ORDER BY event_id) AS mid_u FROM quotes GROUP BY ALL), es AS (SELECT t.symbol, t.event_id, t.ts_ms, CASE WHEN q.mid_u > 0 THEN 2.0 * abs(t.price_u - q.mid_u) / q.mid_u END AS spread FROM trades t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts_ms >= q.ts_ms),
 ek AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC, event_id DESC) AS k FROM es)"""
)


@query(
    f"""WITH {SPREADS}, m AS (SELECT symbol, count(*) AS n, count(*) FILTER (spread IS NULL) AS n_unknown, quantile_cont(spread, 0.5) FILTER (k <= 3) AS a, quantile_cont(spread, 0.5) FILTER (k > 3 AND k <= 9) AS b FROM ek GROUP BY symbol)
 SELECT symbol, n, n_unknown, round(CASE WHEN n >= 9 AND a > 0 THEN b / a END, 6) AS compression FROM m"""
)
def spread_compression(spark, sf_dir):
    """WIN-40: the median spread of earlier trades over that of the last three, counted in trades, not by the clock."""
    near = T.asof_join(V.trades(spark, sf_dir), V.quotes(spark, sf_dir), "symbol", "ts_ms", ["mid_u"], tie="event_id")
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts_ms"), F.desc("event_id")))
    rows = near.select("symbol", X.effective_spread(F.col("price_u"), F.col("mid_u")).alias("s"), k.alias("k"))
    late, early = F.when(F.col("k") <= 3, F.col("s")), F.when(F.col("k").between(4, 9), F.col("s"))
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("s").isNull()).alias("n_unknown"), F.percentile(late, 0.5).alias("a"), F.percentile(early, 0.5).alias("b"))
    return rounded(out.select("symbol", "n", "n_unknown", F.when(F.col("n") >= 9, ratio(F.col("b"), F.col("a"))).alias("compression")), "compression")


def _sides_sql(order: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, CASE WHEN price_u > lag(price_u) OVER w THEN 1 WHEN price_u < lag(price_u) OVER w THEN -1 END AS s FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms // {DAY}, {order})),
 {name} AS (SELECT symbol, event_id, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ms // {DAY}, {order} ROWS UNBOUNDED PRECEDING), 0) AS side FROM {name}0)"""


@query(
    f"""WITH {TICKS}, {_sides_sql("ts_ms, event_id", "a")}, {_sides_sql("md5(CAST(event_id AS VARCHAR) || '-3'), event_id", "b")}
 SELECT count(*) AS n, round(avg(CASE WHEN a.side > 0 THEN 1.0 ELSE 0.0 END), 6) AS buys_stored, round(avg(CASE WHEN b.side > 0 THEN 1.0 ELSE 0.0 END), 6) AS buys_shuffled, round(avg(CASE WHEN a.side <> b.side THEN 1.0 ELSE 0.0 END), 6) AS reclassified FROM a JOIN b USING (symbol, event_id)"""
)
def order_shuffles(spark, sf_dir):
    """WIN-41: what the tick rule says in the stored order, and with prints of one day in a hashed order."""
    from tidemark.operators.controls import shuffled

    ticks = V.ticks(spark, sf_dir).withColumn("h", shuffled(F.col("event_id"), 3))
    stored = tick_rule(ticks, ["event_id"]).select("symbol", "event_id", F.col("side").alias("a"))
    by_day = tick_rule(ticks.withColumn("ts_ms", F.floor(F.col("ts_ms") / DAY)), ["h", "event_id"]).select("symbol", "event_id", F.col("side").alias("b"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return stored.join(by_day, ["symbol", "event_id"]).agg(F.count("*").alias("n"), share(F.col("a") > 0).alias("buys_stored"), share(F.col("b") > 0).alias("buys_shuffled"), share(F.col("a") != F.col("b")).alias("reclassified"))


# Events and execution


@query(
    f"""WITH {HOURS}, q AS (SELECT DISTINCT symbol, ts_ms FROM quotes), b AS (SELECT t.event_id, t.symbol, t.ts_ms, t.ts_ms - h.ts_ms <= {2 * DAY} AS bar FROM trades t ASOF LEFT JOIN hours h ON t.symbol = h.symbol AND t.ts_ms >= h.ts_ms),
 g AS (SELECT b.*, b.ts_ms - q.ts_ms <= {DAY} AS quote FROM b ASOF LEFT JOIN q ON b.symbol = q.symbol AND b.ts_ms >= q.ts_ms), f AS (SELECT g.event_id, coalesce(bar, false) AS bar, coalesce(quote, false) AS quote, coalesce(n.ts_ms - g.ts_ms <= {DAY}, false) AS later FROM g ASOF LEFT JOIN q n ON g.symbol = n.symbol AND g.ts_ms < n.ts_ms)
 SELECT count(*) AS n, count(*) FILTER (bar) AS with_bar, count(*) FILTER (bar AND quote) AS with_quote, count(*) FILTER (bar AND quote AND later) AS measurable FROM f"""
)
def measurability_funnel(spark, sf_dir):
    """EVT-24: how many trades have a bar, a quote before, and one after: each step of those that passed the last."""
    quotes = V.quotes(spark, sf_dir).withColumn("q", F.lit(1))
    near = T.asof_join(V.trades(spark, sf_dir), hours(spark, sf_dir).select("symbol", "ts_ms", "n"), "symbol", "ts_ms", ["n"], tolerance_ms=2 * DAY).withColumnRenamed("n", "bar").drop("right_ts_ms")
    near = T.asof_join(near, quotes, "symbol", "ts_ms", ["q"], tolerance_ms=DAY).withColumnRenamed("q", "quote").drop("right_ts_ms")
    near = T.asof_join(near, quotes, "symbol", "ts_ms", ["q"], tolerance_ms=DAY, forward=True, strict=True).withColumnRenamed("q", "later")
    bar, quote, later = (F.col(c).isNotNull() for c in ("bar", "quote", "later"))
    return near.agg(F.count("*").alias("n"), F.count_if(bar).alias("with_bar"), F.count_if(bar & quote).alias("with_quote"), F.count_if(bar & quote & later).alias("measurable"))


@query(f"WITH {TICKS}, n AS (SELECT symbol, count(*) AS n FROM trades GROUP BY symbol HAVING count(*) >= 3) SELECT symbol, n FROM n ORDER BY n DESC, symbol LIMIT 40")
def most_active(spark, sf_dir):
    """EVT-20: the forty most active symbols that have enough trades."""
    return V.trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "symbol").limit(40)


@query(
    f"""WITH {TICKS}, {LAST}, p AS (SELECT a.entry_id, a.symbol, a.entry_u, max(t.price_u) AS top FROM asked a JOIN ticks t ON a.symbol = t.symbol AND t.ts_ms > a.entry_ms AND t.ts_ms <= a.end_ms GROUP BY ALL), m AS (SELECT e.entry_id, (e.entry_ms + 32400000) // 60000 % 1440 AS m, e.last_u / nullif(CAST(e.entry_u AS DOUBLE), 0) - 1 AS r, p.top / nullif(CAST(e.entry_u AS DOUBLE), 0) - 1 AS c FROM ended e JOIN p USING (entry_id))
 SELECT session, count(*) AS n, round(avg(r), 6) AS rule_mean, round(avg(c), 6) AS ceiling_mean, round(CASE WHEN avg(c) > 0 THEN avg(r) / avg(c) END, 6) AS recovery FROM (SELECT *, {SESSION_SQL} AS session FROM m) GROUP BY session"""
)
def ceiling_recovery(spark, sf_dir):
    """SIM-09: what holding to the horizon recovers of the best price within it, by session."""
    span = 5 * DAY
    of = entries(spark, sf_dir).withColumn("ts_ms", F.col("entry_ms"))
    top = T.range_pairs(of, V.ticks(spark, sf_dir).select("symbol", "ts_ms", "price_u"), "symbol", "ts_ms", 0, span).groupBy("entry_id").agg(F.max("r_price_u").alias("top"))
    last = T.asof_join(of.withColumn("ts_ms", F.col("entry_ms") + span), V.ticks(spark, sf_dir), "symbol", "ts_ms", ["price_u"], tie="event_id")
    both = last.join(top, "entry_id").select(S.session_of(F.col("entry_ms")).alias("session"), (ratio(F.col("price_u"), F.col("entry_u")) - 1).alias("r"), (ratio(F.col("top"), F.col("entry_u")) - 1).alias("c"))
    out = both.groupBy("session").agg(F.count("*").alias("n"), F.avg("r").alias("rule_mean"), F.avg("c").alias("ceiling_mean"))
    return rounded(out.withColumn("recovery", ratio(F.col("rule_mean"), F.col("ceiling_mean"))), "rule_mean", "ceiling_mean", "recovery")


@query(
    f"""WITH {BOOKS}, s AS (SELECT book, sum(q) AS a FROM asks GROUP BY book), r AS (SELECT b.book, b.size // 10 AS band, 2.0 * 10000 * b.size / b.px AS spread, s.a AS depth FROM books b JOIN s USING (book))
 SELECT band, count(*) AS n, round(quantile_cont(spread, 0.5), 9) AS median_spread, round(quantile_cont(CAST(depth AS DOUBLE), 0.5), 4) AS median_depth FROM r GROUP BY band"""
)
def book_table(spark, sf_dir):
    """SIM-20: medians of spread and depth by a key of the books."""
    first = lambda side: F.get(F.col(side), F.lit(0))["price_u"]
    depth = F.aggregate("asks", F.lit(0).cast("long"), lambda acc, x: acc + x["qty_u"])
    rows = V.books(spark, sf_dir).select(F.floor((first("asks") - first("bids")) / 20_000 / 10).alias("band"), X.relative_spread(first("bids"), first("asks")).alias("s"), depth.cast("double").alias("d"))
    out = rows.groupBy("band").agg(F.count("*").alias("n"), F.round(F.percentile("s", 0.5), 9).alias("median_spread"), F.percentile("d", 0.5).alias("median_depth"))
    return rounded(out, "median_depth", digits=4)


# Stream twins


@query(
    f"""WITH {TICKS}, g AS (SELECT *, lag(ts_ms) OVER w AS p_ms, lag(price_u) OVER w AS p_u FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, event_id))
 SELECT CASE WHEN p_ms IS NULL THEN 'first_print' WHEN ts_ms - p_ms >= {2 * DAY} THEN 'awakened' WHEN price_u <> p_u THEN 'moved' ELSE 'unchanged' END AS state, count(*) AS n, round(avg(ts_ms - p_ms), 2) AS mean_age_ms FROM g GROUP BY 1"""
)
def price_activity(spark, sf_dir):
    """STR-08: what each print says of its symbol: the first one, awake again, moved or unchanged."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", "event_id")
    age = F.col("ts_ms") - F.lag("ts_ms").over(w)
    state = F.when(age.isNull(), "first_print").when(age >= 2 * DAY, "awakened").when(F.col("price_u") != F.lag("price_u").over(w), "moved").otherwise("unchanged")
    out = V.ticks(spark, sf_dir).select(state.alias("state"), age.alias("age")).groupBy("state").agg(F.count("*").alias("n"), F.avg("age").alias("mean_age_ms"))
    return rounded(out, "mean_age_ms", digits=2)


@query(
    f"""WITH {RANKS} SELECT ranking_type, symbol, snap_ms, count(*) OVER w AS n_held, CAST(min(rank) OVER w AS INTEGER) AS best_rank FROM ranks WINDOW w AS (PARTITION BY ranking_type, symbol ORDER BY snap_ms RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW)"""
)
def ranking_buffer(spark, sf_dir):
    """STR-07: what a buffer of three days holds of a symbol at each snapshot."""
    w = Window.partitionBy("ranking_type", "symbol").orderBy("snap_ms").rangeBetween(-3 * DAY, 0)
    return V.rankings(spark, sf_dir).select("ranking_type", "symbol", "snap_ms", F.count("*").over(w).alias("n_held"), F.min("rank").over(w).alias("best_rank"))


@query(
    f"""WITH {RANKS}, g AS (SELECT symbol, quantile_cont(price_u, 0.5) AS med FROM ticks GROUP BY symbol), t AS (SELECT r.*, lag(idx) OVER (PARTITION BY ranking_type, r.symbol ORDER BY idx) AS prev FROM numbered r WHERE rank <= 10)
 SELECT ranking_type, snap_ms, symbol, coalesce(med BETWEEN 20000000 AND 90000000, false) AS in_universe FROM t JOIN g USING (symbol) WHERE prev IS NULL OR prev < idx - 1"""
)
def ranking_triggers(spark, sf_dir):
    """STR-12: symbols that come into a list's first ten, and whether the universe's gate lets them through."""
    from tidemark.operators.rankings import numbered

    top = numbered(V.rankings(spark, sf_dir)).where("rank <= 10")
    prev = F.lag("idx").over(Window.partitionBy("ranking_type", "symbol").orderBy("idx"))
    gate = V.ticks(spark, sf_dir).groupBy("symbol").agg(F.coalesce(F.percentile("price_u", 0.5).between(20_000_000, 90_000_000), F.lit(False)).alias("in_universe"))
    return top.withColumn("p", prev).where("p is null or p < idx - 1").join(gate, "symbol").select("ranking_type", "snap_ms", "symbol", "in_universe")


@query(
    f"""WITH {RANKS}, s AS (SELECT snap_ms, symbol, amount, row_number() OVER (PARTITION BY snap_ms ORDER BY amount DESC, symbol) AS k FROM ranks WHERE ranking_type = 'events' AND amount >= 30000000), h AS (SELECT *, k <= 15 AS seated FROM s)
 SELECT snap_ms, count(*) AS n_wanted, count(*) FILTER (seated) AS n_seated, CAST(min(amount) FILTER (seated) AS DOUBLE) AS weakest_seated, CAST(max(amount) FILTER (NOT seated) AS DOUBLE) AS strongest_left FROM h GROUP BY snap_ms"""
)
def fill_to_capacity(spark, sf_dir):
    """STR-10: seats filled by the best scores above a floor: how many want one, and where the line falls."""
    k = F.row_number().over(Window.partitionBy("snap_ms").orderBy(F.desc("amount"), "symbol"))
    seated = V.rankings(spark, sf_dir).where("ranking_type = 'events' and amount >= 30000000").withColumn("seated", k <= 15)
    out = seated.groupBy("snap_ms").agg(F.count("*").alias("n_wanted"), F.count_if("seated").alias("n_seated"), F.min(F.when(F.col("seated"), F.col("amount"))).alias("weakest_seated"), F.max(F.when(~F.col("seated"), F.col("amount"))).alias("strongest_left"))
    return doubles(out, "weakest_seated", "strongest_left")


@query(
    f"""WITH {TICKS}, s AS (SELECT symbol, ts_ms - {DAY} AS a, ts_ms + {DAY // 2} AS b FROM trades), m AS (SELECT *, max(b) OVER (PARTITION BY symbol ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s),
 g AS (SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT symbol, min(a) AS from_ms, max(b) AS to_ms, count(*) AS n_merged FROM g GROUP BY symbol, k"""
)
def merged_spans(spark, sf_dir):
    """STR-18: windows of history that overlap, put together."""
    spans = V.trades(spark, sf_dir).select("symbol", (F.col("ts_ms") - DAY).alias("a"), (F.col("ts_ms") + DAY // 2).alias("b"))
    w = Window.partitionBy("symbol").orderBy("a", "b")
    seen = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("__n", (seen.isNull() | (F.col("a") > seen)).cast("int")).withColumn("k", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return fresh.groupBy("symbol", "k").agg(F.min("a").alias("from_ms"), F.max("b").alias("to_ms"), F.count("*").alias("n_merged")).drop("k")


# Scalar functions


@query(f"""WITH {TICKS} SELECT event_id, strftime(epoch_ms(ts_ms), '%Y-%m-%dT%H:%M:%S') || 'Z' AS utc, strftime(epoch_ms(ts_ms + 32400000), '%Y-%m-%dT%H:%M:%S') || '+09:00' AS kst, ts_ms // 1000 * 1000 AS back_ms FROM trades""")
def iso_times(spark, sf_dir):
    """FN-02: instants as ISO text in two zones, and read again; text without an offset is refused."""
    shown = lambda shift: F.date_format(F.timestamp_millis(F.col("ts_ms") + shift), "yyyy-MM-dd'T'HH:mm:ss")
    out = V.trades(spark, sf_dir).select("event_id", F.concat(shown(0), F.lit("Z")).alias("utc"), F.concat(shown(9 * HOUR), F.lit("+09:00")).alias("kst"))
    return out.withColumn("back_ms", F.when(F.col("kst").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.unix_millis(F.try_to_timestamp("kst"))))


@query(
    f"""WITH {TR} SELECT symbol, count(*) AS n, round(avg(close_u), 1) AS mean_u, round(CASE WHEN count(*) >= 2 THEN stddev_samp(close_u) END, 1) AS std_u, round((max(high_u) - min(low_u)) / CAST(arg_max(close_u, day) AS DOUBLE), 6) AS range_pct, round(avg(true_range_u) / CAST(arg_max(close_u, day) AS DOUBLE), 6) AS atr_pct FROM tr GROUP BY symbol"""
)
def range_statistics(spark, sf_dir):
    """FN-04, 05: mean and deviation of closes, and the range and true range against the last close."""
    last = F.max_by("close_u", "day")
    bars = L.true_range(V.candles_1d(spark, sf_dir))
    out = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("close_u"), 1).alias("mean_u"), F.round(F.stddev_samp("close_u"), 1).alias("std_u"), ratio(F.max("high_u") - F.min("low_u"), last).alias("range_pct"), ratio(F.avg("true_range_u"), last).alias("atr_pct"))
    return rounded(out, "range_pct", "atr_pct")


@query(
    f"""WITH {TICKS}, a AS (SELECT symbol, sum(CAST(price_u AS HUGEINT) * qty_u) AS u12, count(*) AS n, min(price_u) AS low FROM trades GROUP BY symbol) SELECT symbol, round(u12 / 1000000000000.0, 4) AS amount_usd,
 CAST(json_object('symbol', symbol, 'n', n, 'low', CASE WHEN low > 10000000 THEN low END) AS VARCHAR) AS record FROM a"""
)
def json_records(spark, sf_dir):
    """FN-07, 09: amounts in dollars from exact products, and records as JSON in which what isn't a number is null."""
    product = F.sum(F.col("price_u").cast("decimal(19,0)") * F.col("qty_u").cast("decimal(19,0)"))
    a = V.trades(spark, sf_dir).groupBy("symbol").agg(product.alias("u12"), F.count("*").alias("n"), F.min("price_u").alias("low"))
    low = F.when(F.col("low") > 10_000_000, F.col("low").cast("double")).otherwise(float("nan"))
    safe = F.when(~F.isnan(low), low).cast("long").alias("low")
    record = F.to_json(F.struct("symbol", "n", safe), {"ignoreNullFields": "false"})
    return a.select("symbol", F.round(F.col("u12").cast("double") / 1e12, 4).alias("amount_usd"), record.alias("record"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS meta_k FROM events")
def expand_meta(spark, sf_dir):
    """FN-10: the keys of a JSON column as columns of their own, never over those that are there."""
    return V.table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("meta_k"))


def _fit(window: int) -> tuple[list[float], list[float]]:
    import numpy as np

    rows = np.linalg.pinv(np.vander(np.arange(-window, 1, dtype=float), 3, increasing=True))
    return rows[1].tolist(), (2 * rows[2]).tolist()


def _kernel_sql(weights: list[float]) -> str:
    return " + ".join(f"CAST(lag(close_u, {4 - k}) OVER w AS DOUBLE) * ({x!r})" for k, x in enumerate(weights))


@query(
    f"""WITH {HOURS} SELECT symbol, ts_ms, round({_kernel_sql(_fit(4)[0])}, 2) AS velocity, round({_kernel_sql(_fit(4)[1])}, 2) AS acceleration FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)"""
)
def price_derivatives(spark, sf_dir):
    """WIN-16: velocity and acceleration of closes by the weights of a quadratic fit."""
    return rounded(L.quadratic_derivatives(hours(spark, sf_dir), 4, "ts_ms").select("symbol", "ts_ms", "velocity", "acceleration"), "velocity", "acceleration", digits=2)
