"""The library's registered queries, each with the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import sessions as S
from tidemark.operators import bars as B
from tidemark.operators import baselines as L
from tidemark.operators import events as E
from tidemark.operators import execution as X
from tidemark.operators import quality as Q
from tidemark.operators import rankings as R
from tidemark.operators import stats as A
from tidemark.operators import temporal as T
from tidemark.sources import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = V.HOUR_MS, V.DAY_MS

TICKS = """ticks AS (SELECT user_id AS symbol, event_id, epoch_us(ts) // 1000 AS ts_ms, CAST(round(value * 1000000) AS BIGINT) AS price_u,
 CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) * 1000000 AS qty_u, event_type AS kind FROM events),
 trades AS (SELECT * FROM ticks WHERE kind = 'purchase'), quotes AS (SELECT symbol, event_id, ts_ms, price_u AS mid_u FROM ticks WHERE kind = 'view')"""
BARS = """items AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, CAST(round(l_extendedprice / l_quantity * 1000000) AS BIGINT) AS price_u,
 CAST(l_quantity AS BIGINT) AS qty, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, CAST(round(l_extendedprice * 100) AS BIGINT) AS k4 FROM lineitem),
 bars AS (SELECT symbol, day, first(price_u ORDER BY k1, k2, k3, k4, qty) AS open_u, max(price_u) AS high_u, min(price_u) AS low_u,
 last(price_u ORDER BY k1, k2, k3, k4, qty) AS close_u, CAST(sum(qty) AS BIGINT) AS vol FROM items GROUP BY symbol, day)"""
HOURS = TICKS + f""", hours AS (SELECT symbol, (ts_ms // {HOUR} + 1) * {HOUR} AS ts_ms, first(price_u ORDER BY ts_ms, event_id) AS open_u, max(price_u) AS high_u,
 min(price_u) AS low_u, last(price_u ORDER BY ts_ms, event_id) AS close_u, CAST(sum(qty_u) AS BIGINT) AS vol_qu, count(*) AS n,
 CAST(sum(CAST(price_u AS HUGEINT) * qty_u) // 1000000 AS BIGINT) AS notional_u,
 CAST(CASE WHEN sum(qty_u) > 0 THEN sum(CAST(price_u AS HUGEINT) * qty_u) // sum(qty_u) END AS BIGINT) AS vwap_u FROM ticks GROUP BY symbol, ticks.ts_ms // {HOUR})"""
RANKS = TICKS + f""", amounts AS (SELECT ts_ms // {DAY} * {DAY} AS snap_ms, 'events' AS ranking_type, symbol, CAST(sum(price_u) AS BIGINT) AS amount FROM ticks GROUP BY ALL
 UNION ALL SELECT ts_ms // {DAY} * {DAY}, 'purchases', symbol, CAST(sum(price_u) AS BIGINT) FROM trades GROUP BY ALL),
 ranks AS (SELECT *, row_number() OVER (PARTITION BY snap_ms, ranking_type ORDER BY amount DESC, symbol) AS rank FROM amounts),
 snaps AS (SELECT ranking_type, snap_ms, row_number() OVER (PARTITION BY ranking_type ORDER BY snap_ms) AS idx, count(*) OVER (PARTITION BY ranking_type) AS n FROM (SELECT DISTINCT ranking_type, snap_ms FROM ranks)),
 numbered AS (SELECT r.*, s.idx, s.n FROM ranks r JOIN snaps s USING (ranking_type, snap_ms))"""
LEDGER = """ledger AS (SELECT o_custkey AS symbol, o_orderkey AS seq, epoch_us(o_orderdate) // 1000 AS ts_ms, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS to_tier FROM orders)"""
BOOKS = """books AS (SELECT p_partkey AS book, CAST(round(p_retailprice * 1000000) AS BIGINT) AS px, CAST(p_size AS BIGINT) AS size FROM part),
 asks AS (SELECT book, i, px + i * 10000 * size AS p, size * i * 100000 AS q FROM books, range(1, 6) t(i)), bids AS (SELECT book, i, px - i * 10000 * size AS p, size * i * 100000 AS q FROM books, range(1, 6) t(i))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Quotients of cents often end in a five just behind the last digit; a millionth of a millionth more, they round alike anywhere.
NUDGE = 1.000000000001


def rounded(df: DataFrame, *columns: str, digits: int = 6, nudge: bool = False) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) * NUDGE if nudge else F.col(c), digits) for c in columns})


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that can be null, as doubles: both engines' results then have one type."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.time_bars(V.ticks(spark, sf_dir), HOUR, ["event_id"])


def text_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


# Scans, projections, sessions


@query(f"WITH {TICKS} SELECT symbol, event_id, ts_ms, price_u, qty_u FROM trades WHERE symbol = 7 AND ts_ms BETWEEN 1704412800000 AND 1705708800000")
def scan_range(spark, sf_dir):
    """SRC-01, 02, 23: one symbol over a closed range of time."""
    return V.trades(spark, sf_dir).where("symbol = 7 and ts_ms between 1704412800000 and 1705708800000")


@query(
    f"""WITH {TICKS}, m AS (SELECT *, (ts_ms + 32400000) // 60000 % 1440 AS m FROM ticks) SELECT CASE WHEN m >= 540 AND m < 1020 THEN 'day' WHEN m >= 1020 AND m < 1350 THEN 'pre'
 WHEN m >= 1350 OR m < 300 THEN 'regular' WHEN m >= 300 AND m < 530 THEN 'after' ELSE 'closed' END AS session, CAST(DATE '1970-01-01' + CAST(ts_ms // 86400000 AS INTEGER) AS VARCHAR)[:10] AS cycle, count(*) AS n FROM m GROUP BY ALL"""
)
def session_counts(spark, sf_dir):
    """FLT-02..04, AGG-12: events by session and cycle date."""
    t = F.col("ts_ms")
    return V.ticks(spark, sf_dir).groupBy(S.session_of(t).alias("session"), S.session_date(t).cast("string").alias("cycle")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {TICKS}, p AS (SELECT price_u / 1000000.0 AS px FROM ticks) SELECT CASE WHEN px IS NULL OR px <= 0 THEN 'unknown' WHEN px < 0.5 THEN '$0.10-0.50' WHEN px < 1 THEN '$0.50-1' WHEN px < 2 THEN '$1-2'
 WHEN px < 5 THEN '$2-5' WHEN px < 20 THEN '$5-20' ELSE '$20+' END AS band, count(*) AS n, round(avg(px), 6) AS mean_px FROM p GROUP BY ALL"""
)
def price_bands(spark, sf_dir):
    """FLT-13, 14, 16: prices by band."""
    px = F.col("price_u") / 1e6
    return rounded(V.ticks(spark, sf_dir).groupBy(S.price_band(px).alias("band")).agg(F.count("*").alias("n"), F.avg(px).alias("mean_px")), "mean_px")


@query(
    "SELECT p_partkey AS symbol, CAST(floor(p_retailprice * p_size) AS BIGINT) AS cap FROM part WHERE p_size BETWEEN 5 AND 40 AND p_retailprice BETWEEN 900 AND 1500"
)
def universe_filter(spark, sf_dir):
    """FLT-17: size and price ranges, value of the whole rounded down."""
    part = V.table(spark, sf_dir, "part").where("p_size between 5 and 40 and p_retailprice between 900 and 1500")
    return part.select(F.col("p_partkey").alias("symbol"), F.floor(F.col("p_retailprice") * F.col("p_size")).cast("long").alias("cap"))


@query(f"WITH {TICKS}, d AS (SELECT DISTINCT symbol, ts_ms, price_u, qty_u FROM trades) SELECT symbol, count(*) AS n, max(ts_ms) AS last_ms FROM d GROUP BY symbol")
def trades_deduplicated(spark, sf_dir):
    """SRC-09: prints are a set on all their fields."""
    return V.trades(spark, sf_dir).dropDuplicates(["symbol", "ts_ms", "price_u", "qty_u"]).groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ms"))


@query(f"WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC, seq DESC) AS k FROM ledger) SELECT symbol, seq, ts_ms, to_tier FROM r WHERE k = 1")
def upsert_last_wins(spark, sf_dir):
    """SRC-12: the latest row of each key."""
    from tidemark.sources.store import last_wins

    return last_wins(V.ledger(spark, sf_dir), ["symbol"], ["ts_ms", "seq"])


@query(
    f"""WITH {LEDGER}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC, seq DESC) AS r FROM ledger WHERE ts_ms < 820454400000), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC, seq DESC) AS r FROM ledger WHERE ts_ms >= 820454400000 AND symbol % 3 > 0)
 SELECT coalesce(n.symbol, k.symbol) AS symbol, coalesce(n.seq, k.seq) AS seq, n.symbol IS NOT NULL AS changed FROM (SELECT * FROM k WHERE r = 1) k FULL JOIN (SELECT * FROM n WHERE r = 1) n ON k.symbol = n.symbol"""
)
def upsert_merge(spark, sf_dir):
    """SRC-05, 06: a table with the last change of each key in place of its row, and new keys added."""
    from tidemark.sources.store import last_wins, upsert

    ledger, cut = V.ledger(spark, sf_dir), 820454400000
    current = last_wins(ledger.where(F.col("ts_ms") < cut), ["symbol"], ["ts_ms", "seq"]).withColumn("changed", F.lit(False))
    changes = ledger.where((F.col("ts_ms") >= cut) & (F.col("symbol") % 3 > 0)).withColumn("changed", F.lit(True))
    return upsert(current, changes, ["symbol"], ["ts_ms", "seq"]).select("symbol", "seq", "changed")


# Bars and tape


@query(f"WITH {HOURS} SELECT * REPLACE (CAST(vwap_u AS DOUBLE) AS vwap_u) FROM hours")
def ohlcv_bars(spark, sf_dir):
    """AGG-01, 02, FN-08: hourly bars with exact notional and VWAP."""
    return doubles(hours(spark, sf_dir), "vwap_u")


SIDES = (
    TICKS
    + """, signs AS (SELECT *, CASE WHEN price_u > lag(price_u) OVER w THEN 1 WHEN price_u < lag(price_u) OVER w THEN -1 END AS s FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, event_id)),
 sided AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING), 0) AS side FROM signs)"""
)


@query(f"WITH {SIDES} SELECT symbol, event_id, CAST(side AS INTEGER) AS side FROM sided")
def tick_rule(spark, sf_dir):
    """WIN-21: side of each print by the tick rule."""
    return B.tick_rule(V.ticks(spark, sf_dir), ["event_id"]).select("symbol", "event_id", "side")


FLOW = (
    SIDES
    + f""", w0 AS (SELECT symbol, ts_ms // {DAY} * {DAY} AS start_ms, count(*) AS n, count(*) FILTER (side > 0) AS buys, count(*) FILTER (side < 0) AS sells, first(price_u ORDER BY ts_ms, event_id) AS first_u,
 last(price_u ORDER BY ts_ms, event_id) AS last_u FROM sided GROUP BY symbol, sided.ts_ms // {DAY}), w1 AS (SELECT *, CASE WHEN buys + sells > 0 THEN (buys - sells) / CAST(buys + sells AS DOUBLE) END AS imbalance, CASE WHEN first_u > 0 AND last_u > 0 THEN ln(last_u / CAST(first_u AS DOUBLE)) * 10000 END AS ret_bp FROM w0),
 flow AS (SELECT *, CASE WHEN lead(start_ms) OVER w = start_ms + {DAY} THEN lead(ret_bp) OVER w END AS next_ret_bp FROM w1 WINDOW w AS (PARTITION BY symbol ORDER BY start_ms))"""
)


def flow(spark, sf_dir):
    return B.flow_windows(B.tick_rule(V.ticks(spark, sf_dir), ["event_id"]), DAY, ["event_id"])


@query(f"WITH {FLOW} SELECT symbol, start_ms, n, buys, sells, first_u, last_u, round(imbalance, 6) AS imbalance, round(ret_bp, 4) AS ret_bp, round(next_ret_bp, 4) AS next_ret_bp FROM flow")
def flow_windows(spark, sf_dir):
    """AGG-02, WIN-20: tumbling windows of signed flow and returns."""
    return rounded(rounded(flow(spark, sf_dir), "imbalance"), "ret_bp", "next_ret_bp", digits=4)


@query(
    f"""WITH {FLOW}, e AS (SELECT quantile_cont(imbalance, 0.2) AS a, quantile_cont(imbalance, 0.4) AS b, quantile_cont(imbalance, 0.6) AS c, quantile_cont(imbalance, 0.8) AS d, min(imbalance) AS lo, max(imbalance) AS hi FROM flow),
 k AS (SELECT ret_bp, next_ret_bp, len(list_filter(list_filter(list_distinct([a, b, c, d]), lambda x: x > lo AND x < hi), lambda x: x < imbalance)) AS bucket FROM flow, e WHERE imbalance IS NOT NULL)
 SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, round(avg(ret_bp), 4) AS same_bp, round(avg(next_ret_bp), 4) AS next_bp FROM k GROUP BY bucket"""
)
def flow_price_response(spark, sf_dir):
    """AGG-04: returns by quantile bucket of imbalance."""
    out = A.bucketed(flow(spark, sf_dir).where("imbalance is not null"), "imbalance", 5).groupBy("bucket")
    return rounded(out.agg(F.count("*").alias("n"), F.avg("ret_bp").alias("same_bp"), F.avg("next_ret_bp").alias("next_bp")), "same_bp", "next_bp", digits=4)


@query(f"WITH {TICKS}, b AS (SELECT symbol, ts_ms // {DAY} AS b, count(*) AS n FROM ticks GROUP BY ALL) SELECT count(*) AS n_buckets, round(avg(CASE WHEN n >= 4 THEN 1.0 ELSE 0 END), 6) AS share_at_cap, round(sum(CASE WHEN n >= 4 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS share_of_rows FROM b")
def tape_saturation(spark, sf_dir):
    """AGG-22: buckets at the cap."""
    return rounded(B.saturation(V.ticks(spark, sf_dir), DAY, 4), "share_at_cap", "share_of_rows")


# Joins in time


@query(
    f"""WITH {TICKS}, q AS (SELECT symbol, ts_ms, last(mid_u ORDER BY event_id) AS mid_u FROM quotes GROUP BY ALL) SELECT t.symbol, t.event_id, CAST(CASE WHEN t.ts_ms - q.ts_ms <= {2 * DAY} THEN q.ts_ms END AS DOUBLE) AS quote_ms,
 CAST(CASE WHEN t.ts_ms - q.ts_ms <= {2 * DAY} THEN q.mid_u END AS DOUBLE) AS mid_u FROM trades t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts_ms >= q.ts_ms"""
)
def asof_trade_quote(spark, sf_dir):
    """JOIN-05, 06, 08, 13: the quote in force at each trade, no older than two days."""
    out = T.asof_join(V.trades(spark, sf_dir), V.quotes(spark, sf_dir), "symbol", "ts_ms", ["mid_u"], tolerance_ms=2 * DAY, tie="event_id", slice_ms=7 * DAY)
    return doubles(out.select("symbol", "event_id", F.col("right_ts_ms").alias("quote_ms"), "mid_u"), "quote_ms", "mid_u")


@query(
    f"""WITH {TICKS}, q AS (SELECT symbol, ts_ms, first(mid_u ORDER BY event_id) AS mid_u FROM quotes GROUP BY ALL) SELECT t.symbol, t.event_id, CAST(CASE WHEN q.ts_ms - t.ts_ms <= {DAY} THEN q.ts_ms END AS DOUBLE) AS quote_ms,
 CAST(CASE WHEN q.ts_ms - t.ts_ms <= {DAY} THEN q.mid_u END AS DOUBLE) AS mid_u FROM trades t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts_ms < q.ts_ms"""
)
def asof_forward(spark, sf_dir):
    """JOIN-09, 14, 21: the first quote strictly after each trade, within a day."""
    out = T.asof_join(V.trades(spark, sf_dir), V.quotes(spark, sf_dir), "symbol", "ts_ms", ["mid_u"], tolerance_ms=DAY, forward=True, strict=True, tie="event_id")
    return doubles(out.select("symbol", "event_id", F.col("right_ts_ms").alias("quote_ms"), "mid_u"), "quote_ms", "mid_u")


@query(
    f"""WITH {TICKS} SELECT t.symbol, t.event_id, count(*) FILTER (k.ts_ms > t.ts_ms - {DAY} AND k.ts_ms <= t.ts_ms) AS before, count(*) FILTER (k.ts_ms > t.ts_ms AND k.ts_ms <= t.ts_ms + {DAY}) AS after
 FROM trades t JOIN ticks k ON t.symbol = k.symbol GROUP BY ALL"""
)
def window_counts(spark, sf_dir):
    """JOIN-10, 16, WIN-23: prints of the day before and of the day after each trade."""
    out = T.window_counts(V.trades(spark, sf_dir), V.ticks(spark, sf_dir), "symbol", "ts_ms", {"before": (-DAY, 0), "after": (0, DAY)})
    return out.select("symbol", "event_id", "before", "after")


@query(
    f"""WITH {TICKS} SELECT t.symbol, t.event_id, bool_or(q.ts_ms IS NOT NULL) AS near_quote FROM trades t LEFT JOIN quotes q ON t.symbol = q.symbol AND q.ts_ms - t.ts_ms > -{HOUR * 6} AND q.ts_ms - t.ts_ms <= {HOUR * 6} GROUP BY ALL"""
)
def interval_join(spark, sf_dir):
    """JOIN-07, 11, 18: trades with a quote of the symbol within six hours."""
    trades = V.trades(spark, sf_dir)
    near = T.range_pairs(trades, V.quotes(spark, sf_dir), "symbol", "ts_ms", -6 * HOUR, 6 * HOUR).select("event_id").distinct().withColumn("near_quote", F.lit(True))
    return trades.select("symbol", "event_id").join(near, "event_id", "left").withColumn("near_quote", F.coalesce("near_quote", F.lit(False)))


@query(
    f"""WITH {TICKS} SELECT t.symbol, t.event_id, bool_or(i.ts_ms IS NOT NULL) AS overlaps FROM trades t LEFT JOIN (SELECT symbol, ts_ms, ts_ms + {HOUR * 3} AS hi FROM ticks WHERE kind = 'error') i
 ON t.symbol = i.symbol AND i.ts_ms <= t.ts_ms + {HOUR * 12} AND i.hi >= t.ts_ms GROUP BY ALL"""
)
def interval_overlap(spark, sf_dir):
    """JOIN-11, 12: whether a trade's forward window meets an outage of its symbol."""
    down = V.ticks(spark, sf_dir).where("kind = 'error'").select("symbol", F.col("ts_ms").alias("lo"), (F.col("ts_ms") + 3 * HOUR).alias("hi"))
    return T.overlaps(V.trades(spark, sf_dir), down, "symbol", "ts_ms", 12 * HOUR, "lo", "hi").select("symbol", "event_id", "overlaps")


@query(
    f"""WITH {LEDGER}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts_ms ORDER BY seq DESC) AS r FROM ledger) SELECT symbol, seq, to_tier, ts_ms AS valid_from, CAST(lead(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS DOUBLE) AS valid_to FROM k WHERE r = 1"""
)
def ledger_validity(spark, sf_dir):
    """JOIN-13, 15, 23, I15: a ledger of changes as periods."""
    out = T.validity(V.ledger(spark, sf_dir), "symbol", "ts_ms", ["seq"]).select("symbol", "seq", "to_tier", "valid_from", "valid_to")
    return doubles(out, "valid_to")


@query(
    f"""WITH {LEDGER}, d AS (SELECT ts_ms AS t, CASE WHEN to_tier = 3 THEN 1 ELSE -1 END AS d FROM ledger WHERE ts_ms < 915148800000), s AS (SELECT greatest(t, 883612800000) AS t, sum(d) AS d FROM (SELECT * FROM d UNION ALL SELECT 883612800000, 0) GROUP BY 1),
 n AS (SELECT t, sum(d) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS n, coalesce(lead(t) OVER (ORDER BY t), 915148800000) - t AS dt FROM s)
 SELECT round(sum(CAST(n AS DOUBLE) * dt) / sum(dt), 4) AS mean_size, CAST(min(n) AS BIGINT) AS min_size, CAST(max(n) AS BIGINT) AS max_size FROM n WHERE dt > 0"""
)
def tier_population(spark, sf_dir):
    """AGG-32: time-weighted size of a set over a year."""
    changes = V.ledger(spark, sf_dir).withColumn("d", F.when(F.col("to_tier") == 3, 1).otherwise(-1).cast("long"))
    return rounded(T.population(changes, "ts_ms", "d", 883612800000, 915148800000), "mean_size", digits=4)


@query(
    f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w > {DAY} THEN 1 ELSE 0 END AS new FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, event_id)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT symbol, CAST(island AS BIGINT) AS island, count(*) AS n, min(ts_ms) AS from_ms, max(ts_ms) AS to_ms FROM i GROUP BY ALL"""
)
def gaps_islands(spark, sf_dir):
    """I6, EVT-13, WIN-18: runs of prints without a gap of a day."""
    runs = T.islands(V.ticks(spark, sf_dir), "symbol", "ts_ms", DAY, ["event_id"])
    return runs.groupBy("symbol", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.min("ts_ms").alias("from_ms"), F.max("ts_ms").alias("to_ms"))


@query(
    f"""WITH {HOURS}, s AS (SELECT symbol, min(ts_ms) AS a, max(ts_ms) AS b FROM hours GROUP BY symbol), g AS (SELECT symbol, unnest(range(a, b + 1, {HOUR})) AS ts_ms FROM s)
 SELECT g.symbol, count(*) AS n_slots, count(*) FILTER (h.symbol IS NULL) AS n_empty, CAST(sum(coalesce(h.vol_qu, 0)) AS BIGINT) AS vol FROM g LEFT JOIN hours h ON g.symbol = h.symbol AND g.ts_ms = h.ts_ms GROUP BY g.symbol"""
)
def dense_grid(spark, sf_dir):
    """I14, FEAT-02: bars at every hour, with no volume where there were none."""
    grid = T.dense_grid(hours(spark, sf_dir), "symbol", "ts_ms", HOUR, ["vol_qu"])
    return grid.groupBy("symbol").agg(F.count("*").alias("n_slots"), F.count_if(F.col("n").isNull()).alias("n_empty"), F.sum("vol_qu").alias("vol"))


# Baselines

TR = (
    BARS
    + """, tr AS (SELECT *, greatest(high_u - low_u, coalesce(abs(high_u - lag(close_u) OVER w), high_u - low_u), coalesce(abs(low_u - lag(close_u) OVER w), high_u - low_u)) AS true_range_u, lag(close_u) OVER w AS prev_close_u
 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)), base AS (SELECT *, count(*) OVER w AS n_days, CAST(floor(avg(vol) OVER w) AS BIGINT) AS adv, CAST(floor(sum(true_range_u) OVER w / count(true_range_u) OVER w) AS BIGINT) AS atr_u, avg(vol) OVER w AS vol_mean,
 stddev_samp(vol) OVER w AS vol_std, avg(CASE WHEN vol > 0 THEN ln(vol) END) OVER w AS log_mean, stddev_samp(CASE WHEN vol > 0 THEN ln(vol) END) OVER w AS log_std FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
)


@query(f"WITH {BARS} SELECT symbol, CAST(day AS VARCHAR) AS day, open_u, high_u, low_u, close_u, vol FROM bars")
def daily_bars(spark, sf_dir):
    """AGG-01: daily bars."""
    return text_day(V.candles_1d(spark, sf_dir))


@query(f"WITH {TR} SELECT symbol, CAST(day AS VARCHAR) AS day, true_range_u FROM tr")
def true_range(spark, sf_dir):
    """WIN-01."""
    return text_day(L.true_range(V.candles_1d(spark, sf_dir))).select("symbol", "day", "true_range_u")


@query(f"WITH {TR} SELECT symbol, CAST(day AS VARCHAR) AS day, n_days, CAST(adv AS DOUBLE) AS adv, CAST(atr_u AS DOUBLE) AS atr_u, round(vol_mean, 6) AS vol_mean, round(vol_std, 6) AS vol_std, round(log_mean, 6) AS log_mean, round(log_std, 6) AS log_std FROM base")
def daily_baseline(spark, sf_dir):
    """WIN-02..04: statistics of the 20 bars before each."""
    out = doubles(text_day(L.daily_baseline(V.candles_1d(spark, sf_dir))), "adv", "atr_u")
    return rounded(out, "vol_mean", "vol_std", "log_mean", "log_std").select("symbol", "day", "n_days", "adv", "atr_u", "vol_mean", "vol_std", "log_mean", "log_std")


@query(
    f"WITH {TR} SELECT symbol, CAST(day AS VARCHAR) AS day, prev_close_u, round((ln(vol) - log_mean) / log_std, 6) AS volume_z FROM base WHERE n_days >= 20 AND (close_u - prev_close_u) * 10000 >= 2000 * prev_close_u AND log_std > 0 AND (ln(vol) - log_mean) / log_std >= 1"
)
def screen_daily(spark, sf_dir):
    """FLT-26: days of a large move on unusual volume."""
    return rounded(text_day(L.screen_daily(V.candles_1d(spark, sf_dir), 2000, 1.0)), "volume_z").select("symbol", "day", "prev_close_u", "volume_z")


@query(
    f"""WITH {HOURS}, tp AS (SELECT *, (high_u + low_u + close_u) // 3 AS tp, (ts_ms - 1) // {DAY} AS session FROM hours), r AS (SELECT *, sum(CAST(tp AS HUGEINT) * vol_qu) OVER w AS num, sum(vol_qu) OVER w AS den FROM tp WINDOW w AS (PARTITION BY symbol, session ORDER BY ts_ms ROWS UNBOUNDED PRECEDING))
 SELECT symbol, ts_ms, CAST(CASE WHEN den > 0 THEN num // den ELSE tp END AS BIGINT) AS vwap_u FROM r"""
)
def session_vwap(spark, sf_dir):
    """WIN-10: running VWAP of the day, in exact integers."""
    return L.session_vwap(hours(spark, sf_dir).drop("vwap_u").withColumn("session", F.floor((F.col("ts_ms") - 1) / DAY)), "session").select("symbol", "ts_ms", "vwap_u")


CURVE = (
    HOURS
    + f""", placed AS (SELECT *, (ts_ms - 1) // {DAY} AS date, CASE WHEN ((ts_ms - 1) // {DAY} + 4) % 7 IN (0, 6) THEN 'weekend' ELSE 'week' END AS session, (ts_ms - 1) % {DAY} // {HOUR} AS minute FROM hours),
 days AS (SELECT symbol, session, count(DISTINCT date) AS n_days FROM placed GROUP BY ALL HAVING count(DISTINCT date) >= 3), sums AS (SELECT symbol, session, minute, sum(vol_qu) AS v FROM placed GROUP BY ALL),
 curve AS (SELECT symbol, session, minute, v / CAST(n_days AS DOUBLE) AS mean_vol, sum(v) OVER (PARTITION BY symbol, session ORDER BY minute ROWS UNBOUNDED PRECEDING) / CAST(n_days AS DOUBLE) AS mean_cum, n_days FROM sums JOIN days USING (symbol, session))"""
)


def placed(spark, sf_dir):
    inside = F.col("ts_ms") - 1
    weekday = F.pmod(F.floor(inside / DAY) + 4, F.lit(7))
    return hours(spark, sf_dir).withColumns({"date": F.floor(inside / DAY), "session": F.when(weekday.isin(0, 6), "weekend").otherwise("week"), "minute": F.floor(inside % DAY / HOUR)})


@query(f"WITH {CURVE} SELECT symbol, session, minute, round(mean_vol, 4) AS mean_vol, round(mean_cum, 4) AS mean_cum, n_days FROM curve")
def volume_curve(spark, sf_dir):
    """WIN-05: expected volume by place in the session."""
    return rounded(L.volume_curve(placed(spark, sf_dir), "session", "minute", "date", 3), "mean_vol", "mean_cum", digits=4)


@query(
    f"""WITH {CURVE} SELECT p.symbol, p.ts_ms, round(sum(p.vol_qu) OVER (PARTITION BY p.symbol, p.session, p.date ORDER BY p.ts_ms ROWS UNBOUNDED PRECEDING) / CASE WHEN c.mean_cum > 0 THEN c.mean_cum END, 6) AS rvol
 FROM placed p LEFT JOIN curve c USING (symbol, session, minute)"""
)
def rvol_series(spark, sf_dir):
    """WIN-07..09: volume so far over what is expected."""
    bars = placed(spark, sf_dir)
    return rounded(L.relative_volume(bars, L.volume_curve(bars, "session", "minute", "date", 3), "session", "minute", "date").select("symbol", "ts_ms", "rvol"), "rvol")


@query(
    f"""WITH {BARS}, r AS (SELECT *, ln(close_u / CAST(lag(close_u) OVER (PARTITION BY symbol ORDER BY day) AS DOUBLE)) AS r FROM bars) SELECT symbol, CAST(day AS VARCHAR) AS day, round(CASE WHEN count(r) OVER w >= 5 THEN stddev_samp(r) OVER w END, 6) AS realized_vol
 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)"""
)
def realized_volatility(spark, sf_dir):
    """WIN-17, 22."""
    return rounded(text_day(L.realized_vol(V.candles_1d(spark, sf_dir), 15)), "realized_vol").select("symbol", "day", "realized_vol")


@query(
    f"""WITH {BARS}, m AS (SELECT max(day) AS newest FROM bars) SELECT symbol, count(*) AS n_moves, CAST(max(day) AS VARCHAR) AS last_day FROM bars, m WHERE newest - day <= 400 AND (high_u >= open_u * 1.3 OR low_u <= open_u * 0.7) GROUP BY symbol"""
)
def former_runners(spark, sf_dir):
    """AGG-17."""
    return L.former_runners(V.candles_1d(spark, sf_dir), 400, 0.3).withColumn("last_day", F.col("last_day").cast("string"))


@query(f"WITH {TR} SELECT symbol, CAST(day AS VARCHAR) AS day, round(open_u / CAST(prev_close_u AS DOUBLE), 6) AS ratio FROM tr WHERE open_u / CAST(prev_close_u AS DOUBLE) >= 3 OR open_u / CAST(prev_close_u AS DOUBLE) <= 1 / CAST(3 AS DOUBLE)")
def split_scan(spark, sf_dir):
    """FEAT-16: opens that are a multiple of the close before."""
    return rounded(text_day(L.split_dates(V.candles_1d(spark, sf_dir), 3.0)), "ratio").select("symbol", "day", "ratio")


# Events

EVENTS = (
    TR
    + """, ahead AS (SELECT *, max(high_u) OVER w AS peak, last_value(close_u) OVER w AS last_c, min(low_u) OVER w AS low_a FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
 ev AS (SELECT *, high_u / CAST(prev_close_u AS DOUBLE) - 1 AS ret, peak / CAST(prev_close_u AS DOUBLE) - 1 AS peak_ret, last_c / CAST(prev_close_u AS DOUBLE) - 1 AS ret_close, low_a / CAST(peak AS DOUBLE) - 1 AS drawdown FROM ahead WHERE high_u >= prev_close_u * 1.5),
 labelled AS (SELECT *, CASE WHEN drawdown <= -0.2 THEN 'dump' WHEN ret_close < 0.5 * peak_ret THEN 'fade' ELSE 'hold' END AS outcome FROM ev)"""
)


@query(f"WITH {EVENTS} SELECT symbol, CAST(day AS VARCHAR) AS day, round(ret, 6) AS ret, round(peak_ret, 6) AS peak_ret, round(ret_close, 6) AS ret_close, round(drawdown, 6) AS drawdown, outcome FROM labelled")
def event_labels_daily(spark, sf_dir):
    """EVT-04: threshold moves of daily bars with their labels."""
    out = rounded(text_day(E.daily_events(V.candles_1d(spark, sf_dir), 0.5, 5)), "ret", "peak_ret", "ret_close", "drawdown")
    return out.select("symbol", "day", "ret", "peak_ret", "ret_close", "drawdown", "outcome")


@query(
    f"""WITH {EVENTS} SELECT coalesce(outcome, 'all') AS outcome, count(*) AS n, round(avg(ret_close), 6) AS mean_close, round(quantile_cont(peak_ret, 0.5), 6) AS median_peak, round(avg(CASE WHEN ret_close > 0 THEN 1.0 ELSE 0 END), 6) AS share_up FROM labelled GROUP BY GROUPING SETS ((outcome), ())"""
)
def outcome_table(spark, sf_dir):
    """AGG-09, 10, FEAT-11, 15: persistence by outcome, and of all."""
    ev = E.daily_events(V.candles_1d(spark, sf_dir), 0.5, 5)
    out = ev.groupingSets([[F.col("outcome")], []], "outcome").agg(
        F.count("*").alias("n"), F.avg("ret_close").alias("mean_close"), F.percentile("peak_ret", 0.5).alias("median_peak"), F.avg((F.col("ret_close") > 0).cast("double")).alias("share_up")
    )
    return rounded(out.withColumn("outcome", F.coalesce("outcome", F.lit("all"))), "mean_close", "median_peak", "share_up")


@query(
    f"""WITH {TICKS}, n AS (SELECT *, lag(ts_ms) OVER w AS a, lead(ts_ms) OVER w AS b FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, event_id)) SELECT symbol, event_id, coalesce(ts_ms - a <= {DAY}, false) OR coalesce(b - ts_ms <= {DAY}, false) AS overlaps FROM n"""
)
def overlapping_windows(spark, sf_dir):
    """EVT-26."""
    return E.overlapping(V.trades(spark, sf_dir), DAY).select("symbol", "event_id", "overlaps")


@query(
    f"""WITH RECURSIVE {TICKS}, lows AS (SELECT symbol, ts_ms, price_u, min(price_u) OVER (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW) AS low_u FROM ticks),
 near AS (SELECT *, price_u >= low_u * CAST(1.5 AS DOUBLE) AS above, lag(price_u >= low_u * CAST(1.5 AS DOUBLE)) OVER (PARTITION BY symbol ORDER BY ts_ms) AS before FROM lows),
 edges AS (SELECT symbol, ts_ms, price_u, low_u, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) AS k FROM near WHERE above AND NOT coalesce(before, false)),
 greedy AS (SELECT symbol, k, ts_ms, price_u, low_u, true AS fires, ts_ms AS fired_ms FROM edges WHERE k = 1
  UNION ALL SELECT e.symbol, e.k, e.ts_ms, e.price_u, e.low_u, e.ts_ms - g.fired_ms >= {DAY}, CASE WHEN e.ts_ms - g.fired_ms >= {DAY} THEN e.ts_ms ELSE g.fired_ms END FROM greedy g JOIN edges e ON e.symbol = g.symbol AND e.k = g.k + 1)
 SELECT symbol, ts_ms, price_u, low_u FROM greedy WHERE fires"""
)
def causal_fires(spark, sf_dir):
    """EVT-16, 21: rising edges over the trailing low, with a cooldown."""
    return E.causal_fires(V.ticks(spark, sf_dir), 0.5, 2 * DAY, DAY)


#: From every row on which a search may begin, the first row that lies half above the low since then; searches then follow each other.
IMPULSES = (
    TICKS
    + f""", o AS (SELECT symbol, ts_ms, price_u, row_number() OVER w AS i, coalesce(ts_ms - lag(ts_ms) OVER w > {3 * DAY}, false) AS brk FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
 isl AS (SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM o),
 dips AS (SELECT *, coalesce(price_u < lag(price_u) OVER (PARTITION BY symbol, island ORDER BY i), false) AS dip FROM isl), climbs AS (SELECT *, sum(CAST(dip AS INTEGER)) OVER (PARTITION BY symbol, island ORDER BY i ROWS UNBOUNDED PRECEDING) AS climb FROM dips),
 peaks AS (SELECT *, max(i) OVER (PARTITION BY symbol, island, climb) AS peak_i FROM climbs),
 seen AS (SELECT a.symbol, a.island, a.i AS r, b.i, b.price_u, b.peak_i, min((b.price_u, b.i)) OVER (PARTITION BY a.symbol, a.i ORDER BY b.ts_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS low FROM peaks a JOIN peaks b ON b.symbol = a.symbol AND b.island = a.island AND b.i >= a.i),
 hits AS (SELECT symbol, island, r, min((i, low[2], peak_i)) AS h FROM seen WHERE low[2] < i AND price_u >= low[1] * CAST(1.5 AS DOUBLE) GROUP BY ALL),
 chain AS (SELECT h.symbol, h.island, h.h FROM hits h JOIN (SELECT symbol, island, min(i) AS r FROM isl GROUP BY ALL) f USING (symbol, island, r) UNION ALL SELECT h.symbol, h.island, h.h FROM chain c JOIN hits h ON h.symbol = c.symbol AND h.island = c.island AND h.r = c.h[3] + 1)"""
)


@query(
    f"""WITH RECURSIVE {IMPULSES} SELECT c.symbol, a.ts_ms AS start_ms, b.ts_ms AS detect_ms, p.ts_ms AS peak_ms, a.price_u AS start_u, b.price_u AS detect_u, p.price_u AS peak_u, CAST(row_number() OVER (PARTITION BY c.symbol ORDER BY a.ts_ms) AS INTEGER) AS ordinal
 FROM chain c JOIN o a ON a.symbol = c.symbol AND a.i = c.h[2] JOIN o b ON b.symbol = c.symbol AND b.i = c.h[1] JOIN o p ON p.symbol = c.symbol AND p.i = c.h[3]"""
)
def detect_impulses(spark, sf_dir):
    """EVT-13, 15: greedy upward moves without overlap."""
    return E.impulses(V.ticks(spark, sf_dir), 0.5, DAY, 3 * DAY)


# Rankings


@query(
    f"""WITH {RANKS}, p AS (SELECT *, lag(idx) OVER (PARTITION BY ranking_type, symbol ORDER BY idx) AS prev FROM numbered WHERE rank <= 20) SELECT ranking_type, snap_ms, symbol, CAST(rank AS INTEGER) AS rank FROM p WHERE idx > 1 AND (prev IS NULL OR prev < idx - 1)"""
)
def rank_new_entry(spark, sf_dir):
    """EVT-05, 06."""
    return R.new_entries(V.rankings(spark, sf_dir), 20)


@query(
    f"""WITH {RANKS}, p AS (SELECT *, lag(idx) OVER w AS i, lag(rank) OVER w AS from_rank FROM numbered WINDOW w AS (PARTITION BY ranking_type, symbol ORDER BY idx)) SELECT ranking_type, snap_ms, symbol, CAST(from_rank AS INTEGER) AS from_rank, CAST(rank AS INTEGER) AS rank FROM p WHERE i = idx - 1 AND from_rank - rank >= 30"""
)
def rank_jump(spark, sf_dir):
    """EVT-07."""
    return R.rank_jumps(V.rankings(spark, sf_dir), 30)


@query(
    f"""WITH {RANKS}, p AS (SELECT *, idx - row_number() OVER (PARTITION BY ranking_type, symbol ORDER BY idx) AS run FROM numbered WHERE rank <= 20), r AS (SELECT ranking_type, symbol, run, min(snap_ms) AS snap_ms, min(idx) AS start, count(*) AS run_length, max(n) AS n FROM p GROUP BY ALL)
 SELECT ranking_type, snap_ms, symbol, run_length, (start + run_length - 1 >= n AND run_length < 2) AS censored FROM r WHERE start > 1 AND (run_length >= 2 OR start + run_length - 1 >= n)"""
)
def rank_dwell(spark, sf_dir):
    """EVT-08."""
    return R.dwell_starts(V.rankings(spark, sf_dir), 20, 2)


CHANGES = (
    RANKS
    + """, pres AS (SELECT *, lag(idx) OVER w AS prev, lead(idx) OVER w AS nxt FROM numbered WHERE rank <= 20 WINDOW w AS (PARTITION BY ranking_type, symbol ORDER BY idx)), changes AS (SELECT ranking_type, snap_ms, symbol, 'enter' AS event, CAST(rank AS INTEGER) AS rank FROM pres WHERE idx > 1 AND (prev IS NULL OR prev < idx - 1)
 UNION ALL SELECT p.ranking_type, s.snap_ms, p.symbol, 'exit', NULL FROM pres p JOIN snaps s ON p.ranking_type = s.ranking_type AND s.idx = p.idx + 1 WHERE p.nxt IS NULL OR p.nxt > p.idx + 1)"""
)


@query(f"WITH {CHANGES} SELECT * REPLACE (CAST(rank AS DOUBLE) AS rank) FROM changes")
def ranking_top_changes(spark, sf_dir):
    """EVT-10."""
    return doubles(R.top_changes(V.rankings(spark, sf_dir), 20), "rank")


@query(
    f"""WITH {CHANGES} SELECT x.ranking_type, x.symbol AS exit_symbol, e.symbol AS enter_symbol, x.snap_ms AS exit_ms, e.snap_ms AS enter_ms FROM changes x JOIN changes e ON x.ranking_type = e.ranking_type AND x.event = 'exit' AND e.event = 'enter' AND e.snap_ms >= x.snap_ms AND e.snap_ms < x.snap_ms + {2 * DAY} AND x.symbol <> e.symbol"""
)
def rotation_handoffs(spark, sf_dir):
    """EVT-11."""
    return R.handoffs(R.top_changes(V.rankings(spark, sf_dir), 20), 2 * DAY)


ROTATE_AT = 1705276800000


@query(
    f"""WITH {TICKS}, w AS (SELECT symbol, count(*) FILTER (ts_ms >= {ROTATE_AT - 7 * DAY}) AS n_prints, count(*) FILTER (ts_ms < {ROTATE_AT - 7 * DAY}) AS n_prints_prev, CAST(coalesce(sum(price_u) FILTER (ts_ms >= {ROTATE_AT - 7 * DAY}), 0) AS BIGINT) AS amount,
 CAST(coalesce(sum(price_u) FILTER (ts_ms < {ROTATE_AT - 7 * DAY}), 0) AS BIGINT) AS amount_prev FROM ticks WHERE ts_ms >= {ROTATE_AT - 14 * DAY} AND ts_ms < {ROTATE_AT} GROUP BY symbol), c AS (SELECT * FROM w WHERE n_prints >= 3 AND n_prints_prev >= 3),
 d AS (SELECT *, amount / CAST(sum(amount) OVER () AS DOUBLE) - amount_prev / CAST(sum(amount_prev) OVER () AS DOUBLE) AS share_delta, (rank() OVER (ORDER BY amount_prev DESC) + (count(*) OVER (PARTITION BY amount_prev) - 1) / 2.0) - (rank() OVER (ORDER BY amount DESC) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0) AS rank_delta FROM c)
 SELECT symbol, n_prints, n_prints_prev, amount, amount_prev, round(share_delta, 9) AS share_delta, CAST(rank_delta AS DOUBLE) AS rank_delta, round((rank() OVER (ORDER BY rank_delta) + (count(*) OVER (PARTITION BY rank_delta) - 1) / 2.0) / count(*) OVER (), 6) AS rank_delta_pct FROM d"""
)
def rotation_scores(spark, sf_dir):
    """JOIN-02, AGG-11, WIN-39, FEAT-17."""
    prints = V.ticks(spark, sf_dir).withColumn("amount", F.col("price_u"))
    out = R.rotation_scores(prints, ROTATE_AT, 7 * DAY, 3, 10).drop("share_delta_pct")
    return rounded(rounded(out, "share_delta", digits=9), "rank_delta_pct")


@query(f"WITH {RANKS} SELECT ranking_type, snap_ms, symbol, round(amount / CAST(sum(amount) OVER (PARTITION BY ranking_type, snap_ms) AS DOUBLE), 6) AS share FROM ranks WHERE rank <= 10")
def amount_share(spark, sf_dir):
    """WIN-31, 33."""
    return rounded(R.amount_shares(V.rankings(spark, sf_dir), 10), "share").select("ranking_type", "snap_ms", "symbol", "share")


# Execution


@query(
    f"""WITH {BOOKS}, l AS (SELECT book, i, p, CAST(p AS HUGEINT) * q // 1000000 AS worth FROM asks), c AS (SELECT *, sum(worth) OVER (PARTITION BY book ORDER BY i ROWS UNBOUNDED PRECEDING) - worth AS before FROM l), t AS (SELECT *, least(worth, 5000000000 - before) AS take FROM c WHERE before < 5000000000)
 SELECT book, CAST(sum(take) AS BIGINT) AS spent_u, CAST(sum(CAST(take AS HUGEINT) * 1000000 // p) AS BIGINT) AS shares_qu, CAST(count(*) AS INTEGER) AS levels_used, sum(take) < 5000000000 AS exhausted FROM t GROUP BY book"""
)
def walk_book(spark, sf_dir):
    """SIM-12, 14, 15: what 5,000 dollars take from the asks."""
    return V.books(spark, sf_dir).select("book", X.walk_book(F.col("asks"), 5000.0).alias("w")).select("book", "w.spent_u", "w.shares_qu", "w.levels_used", "w.exhausted")


@query(
    f"""WITH {BOOKS}, l AS (SELECT book, i, p, CAST(p AS HUGEINT) * q // 1000000 AS worth, 1 AS s FROM asks UNION ALL SELECT book, i, p, CAST(p AS HUGEINT) * q // 1000000, -1 FROM bids), c AS (SELECT *, sum(worth) OVER (PARTITION BY book, s ORDER BY i ROWS UNBOUNDED PRECEDING) - worth AS before FROM l),
 t AS (SELECT *, least(worth, 1000000000 - before) AS take FROM c WHERE before < 1000000000), a AS (SELECT book, s, CAST(sum(take) AS DOUBLE) * 1000000 / CAST(sum(CAST(take AS HUGEINT) * 1000000 // p) AS DOUBLE) AS avg_px FROM t GROUP BY ALL)
 SELECT b.book, round((x.avg_px - b.px) / b.px, 9) AS entry_cost, round((b.px - y.avg_px) / b.px, 9) AS exit_cost, round((x.avg_px - b.px) / b.px + (b.px - y.avg_px) / b.px + 0.002, 9) AS total_cost FROM books b JOIN a x ON x.book = b.book AND x.s = 1 JOIN a y ON y.book = b.book AND y.s = -1"""
)
def round_trip_cost(spark, sf_dir):
    """SIM-13, 16, 17: cost of buying and selling 1,000 dollars."""
    return rounded(X.round_trip_cost(V.books(spark, sf_dir), 1000.0, 0.002).select("book", "entry_cost", "exit_cost", "total_cost"), "entry_cost", "exit_cost", "total_cost", digits=9)


@query(
    f"""WITH {TICKS}, q AS (SELECT symbol, ts_ms, last(mid_u ORDER BY event_id) AS mid_u FROM quotes GROUP BY ALL), f AS (SELECT symbol, ts_ms, first(mid_u ORDER BY event_id) AS later_mid_u FROM quotes GROUP BY ALL), n AS (SELECT t.symbol, t.event_id, t.ts_ms, t.price_u, CASE WHEN t.ts_ms - q.ts_ms <= {3 * DAY} THEN q.mid_u END AS mid_u
 FROM trades t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts_ms >= q.ts_ms), m AS (SELECT n.*, n.ts_ms + {HOUR} AS later FROM n), k AS (SELECT m.*, f.later_mid_u FROM m ASOF LEFT JOIN f ON m.symbol = f.symbol AND m.later <= f.ts_ms)
 SELECT symbol, event_id, CAST(mid_u AS DOUBLE) AS mid_u, CAST(later_mid_u AS DOUBLE) AS later_mid_u, CAST(sign(price_u - mid_u) AS DOUBLE) AS side, round(CASE WHEN mid_u > 0 THEN 2.0 * abs(price_u - mid_u) / mid_u END, 6) AS effective_spread, round(sign(price_u - mid_u) * (later_mid_u - mid_u) / nullif(CAST(mid_u AS DOUBLE), 0) * 10000, 4) AS markout_bp FROM k"""
)
def markout(spark, sf_dir):
    """JOIN-05, SIM-18, 19: effective spread and markout of each trade."""
    out = X.align_trades(V.trades(spark, sf_dir), V.quotes(spark, sf_dir), 3 * DAY, HOUR)
    return doubles(rounded(rounded(out, "effective_spread"), "markout_bp", digits=4), "mid_u", "later_mid_u", "side").select("symbol", "event_id", "mid_u", "later_mid_u", "side", "effective_spread", "markout_bp")


@query(
    f"""WITH {HOURS}, e AS (SELECT event_id AS entry_id, symbol, ts_ms AS entry_ms, CAST(price_u AS DOUBLE) AS entry_u FROM trades), p AS (SELECT e.*, h.ts_ms, h.high_u, h.low_u, h.close_u, greatest(entry_u, coalesce(max(h.high_u) OVER (PARTITION BY entry_id ORDER BY h.ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry_u)) AS peak
 FROM e JOIN hours h ON e.symbol = h.symbol AND h.ts_ms >= e.entry_ms AND h.ts_ms <= e.entry_ms + {5 * DAY}), r AS (SELECT *, CASE WHEN low_u <= entry_u * (1 - 0.5) THEN 'stop' WHEN low_u <= peak * (1 - 0.4) AND peak > entry_u THEN 'trail' WHEN high_u >= entry_u * (1 + 1.0) THEN 'target' WHEN ts_ms >= entry_ms + {3 * DAY} THEN 'time' END AS reason,
 CASE WHEN low_u <= entry_u * (1 - 0.5) THEN entry_u * (1 - 0.5) WHEN low_u <= peak * (1 - 0.4) AND peak > entry_u THEN peak * (1 - 0.4) WHEN high_u >= entry_u * (1 + 1.0) THEN entry_u * (1 + 1.0) WHEN ts_ms >= entry_ms + {3 * DAY} THEN close_u END AS px FROM p),
 f AS (SELECT entry_id, arg_min(reason, ts_ms) FILTER (reason IS NOT NULL) AS reason, arg_min(px, ts_ms) FILTER (reason IS NOT NULL) AS px, min(ts_ms) FILTER (reason IS NOT NULL) AS t, arg_max(close_u, ts_ms) AS c, max(ts_ms) AS l FROM r GROUP BY entry_id)
 SELECT e.entry_id, e.symbol, coalesce(f.reason, CASE WHEN f.entry_id IS NULL THEN 'no_path' ELSE 'horizon' END) AS reason, coalesce(f.t, f.l) AS exit_ms, round(coalesce(f.px, f.c) / nullif(e.entry_u, 0) - 1, 6) AS gross FROM e LEFT JOIN f USING (entry_id)"""
)
def exit_rules(spark, sf_dir):
    """SIM-01, 05, 21: stop, trail, target and time over hourly bars."""
    entries = V.trades(spark, sf_dir).select(F.col("event_id").alias("entry_id"), "symbol", F.col("ts_ms").alias("entry_ms"), F.col("price_u").cast("double").alias("entry_u"))
    out = X.simulate_exits(hours(spark, sf_dir), entries, horizon_ms=5 * DAY, stop=0.5, trail=0.4, target=1.0, time_ms=3 * DAY)
    return out.select("entry_id", "symbol", "reason", "exit_ms", F.round(B.ratio(F.col("exit_u"), F.col("entry_u")) - 1, 6).alias("gross"))


# Statistics


@query(f"WITH {TICKS} SELECT kind, count(*) AS n, round(avg(price_u), 4) AS mean, " + ", ".join(f"round(quantile_cont(price_u, {q}), 4) AS {n}" for n, q in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))) + " FROM ticks GROUP BY kind")
def distributions(spark, sf_dir):
    """AGG-03, 08, 09, 28."""
    return rounded(A.distribution(V.ticks(spark, sf_dir), "kind", "price_u"), "mean", "p10", "p25", "median", "p75", "p90", digits=4)


@query(f"WITH {TICKS}, p AS (SELECT symbol, sum(price_u) AS s, count(*) AS n FROM ticks GROUP BY symbol) SELECT round(sum(s) / CAST(sum(n) AS DOUBLE), 4) AS row_mean, round(avg(s / CAST(n AS DOUBLE)), 4) AS group_mean, count(*) AS n_groups FROM p")
def two_scales(spark, sf_dir):
    """AGG-19, STAT-21."""
    return rounded(A.two_scales(V.ticks(spark, sf_dir), "symbol", "price_u"), "row_mean", "group_mean", digits=4)


@query(f"WITH {TICKS}, p AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, symbol) AS r FROM ticks GROUP BY symbol) SELECT " + ", ".join(f"round(sum(CASE WHEN r <= {k} THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS top{k}_share" for k in (1, 5, 12)) + " FROM p")
def concentration(spark, sf_dir):
    """AGG-20."""
    return rounded(A.concentration(V.ticks(spark, sf_dir), "symbol", (1, 5, 12)), "top1_share", "top5_share", "top12_share")


@query(
    f"""WITH {TICKS}, p AS (SELECT kind, price_u AS value, sum(qty_u) AS w FROM ticks WHERE qty_u > 0 GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY kind ORDER BY value ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY kind) AS t FROM p)
 SELECT kind, q AS quantile, min(value) AS value FROM c, (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75)) v(q) WHERE c >= q * t GROUP BY ALL"""
)
def weighted_quantiles(spark, sf_dir):
    """AGG-21."""
    return A.weighted_quantile(V.ticks(spark, sf_dir), "kind", "price_u", "qty_u", (0.25, 0.5, 0.75))


@query(
    f"""WITH {TICKS}, r AS (SELECT kind, rank() OVER (PARTITION BY kind ORDER BY price_u) + (count(*) OVER (PARTITION BY kind, price_u) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY kind ORDER BY qty_u) + (count(*) OVER (PARTITION BY kind, qty_u) - 1) / 2.0 AS ry FROM ticks) SELECT kind, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY kind"""
)
def spearman(spark, sf_dir):
    """STAT-11."""
    return rounded(A.spearman(V.ticks(spark, sf_dir), "kind", "price_u", "qty_u"), "rho")


@query(
    f"""WITH {FLOW} SELECT CAST(l.lag AS INTEGER) AS lag, count(*) AS n, round(corr(a.imbalance, b.ret_bp), 6) AS corr FROM flow a CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) l(lag) JOIN flow b ON a.symbol = b.symbol AND b.start_ms = a.start_ms + l.lag * {DAY} WHERE a.imbalance IS NOT NULL AND b.ret_bp IS NOT NULL GROUP BY l.lag"""
)
def leadlag_correlation(spark, sf_dir):
    """JOIN-03, AGG-18, STAT-07, 25."""
    return rounded(A.lag_correlation(flow(spark, sf_dir), "imbalance", "ret_bp", (-2, -1, 0, 1, 2), DAY), "corr")


@query(
    f"""WITH {TICKS}, g AS (SELECT symbol, count(*) AS n, count(*) FILTER (kind = 'purchase') AS k FROM ticks GROUP BY symbol), p AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1.96 * 1.96 AS zz FROM g)
 SELECT symbol, n, k, round((p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 6) AS low, round((p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 6) AS high FROM p"""
)
def wilson_intervals(spark, sf_dir):
    """AGG-35, STAT-27."""
    g = V.ticks(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "purchase").alias("k"))
    low, high = A.wilson(F.col("k"), F.col("n"))
    return rounded(g.withColumn("low", low).withColumn("high", high), "low", "high")


# Quality


@query(f"WITH {TICKS}, t AS (SELECT DISTINCT symbol, ts_ms FROM ticks), g AS (SELECT symbol, lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS gap_from_ms, ts_ms AS gap_to_ms FROM t) SELECT symbol, gap_from_ms, gap_to_ms, gap_to_ms - gap_from_ms AS gap_ms FROM g WHERE gap_to_ms - gap_from_ms > {DAY}")
def time_gaps(spark, sf_dir):
    """AGG-36, 37, WIN-13, 42."""
    return Q.time_gaps(V.ticks(spark, sf_dir), "symbol", "ts_ms", DAY)


@query(f"WITH {HOURS} SELECT symbol, count(DISTINCT ts_ms) AS n_bars, (max(ts_ms) - min(ts_ms)) // {HOUR} + 1 AS n_expected, round(count(DISTINCT ts_ms) / CAST((max(ts_ms) - min(ts_ms)) // {HOUR} + 1 AS DOUBLE), 6) AS share FROM hours GROUP BY symbol")
def coverage_report(spark, sf_dir):
    """AGG-30, 37, JOIN-24."""
    return rounded(Q.coverage(hours(spark, sf_dir), "symbol", "ts_ms", HOUR), "share")


@query(f"WITH {TICKS}, g AS (SELECT t - lag(t) OVER (ORDER BY t) AS gap FROM (SELECT DISTINCT ts_ms AS t FROM ticks)) SELECT count(gap) AS n_steps, round(avg(gap) FILTER (gap <= 600000), 4) AS mean_ms, round(quantile_cont(gap, 0.5) FILTER (gap <= 600000), 4) AS median_ms, count(*) FILTER (gap > 600000) AS n_beyond FROM g")
def cadence(spark, sf_dir):
    """AGG-33, 13."""
    return rounded(Q.cadence(V.ticks(spark, sf_dir), "ts_ms", 600_000), "mean_ms", "median_ms", digits=4)


@query(
    f"""WITH {HOURS}, w AS (SELECT DISTINCT symbol, ts_ms // {HOUR} * {HOUR} AS t FROM trades), o AS (SELECT w.*, o FROM w, (VALUES (-1), (0), (1), (2)) v(o)) SELECT CAST(o AS INTEGER) AS "offset", count(*) AS n_print_bars, count(h.symbol) AS n_matched FROM o LEFT JOIN hours h ON h.symbol = o.symbol AND h.ts_ms = o.t + o.o * {HOUR} GROUP BY o.o"""
)
def label_offsets(spark, sf_dir):
    """JOIN-24: which label offset makes prints and bars meet."""
    return Q.completeness(V.trades(spark, sf_dir), hours(spark, sf_dir), "symbol", "ts_ms", HOUR, (-1, 0, 1, 2))


@query(f"WITH {TICKS}, f AS (SELECT symbol, min(ts_ms // {DAY}) AS d FROM ticks GROUP BY symbol), a AS (SELECT ts_ms // {DAY} AS d, count(DISTINCT symbol) AS n_symbols FROM ticks GROUP BY 1), b AS (SELECT d, count(*) AS n_first FROM f GROUP BY d) SELECT a.d AS day, n_symbols, coalesce(n_first, 0) AS n_first FROM a LEFT JOIN b USING (d)")
def arrivals(spark, sf_dir):
    """AGG-34: distinct and first-seen symbols by day."""
    ticks = V.ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_ms") / DAY))
    first = ticks.groupBy("symbol").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("n_first"))
    return ticks.groupBy("day").agg(F.countDistinct("symbol").alias("n_symbols")).join(first, "day", "left").withColumn("n_first", F.coalesce("n_first", F.lit(0)))


@query(f"WITH {TICKS}, p AS (SELECT symbol FROM trades), v AS (SELECT symbol FROM ticks WHERE kind = 'signup') SELECT 'only_trades' AS kind, count(*) AS n FROM (SELECT symbol FROM p EXCEPT SELECT symbol FROM v) UNION ALL SELECT 'both', count(*) FROM (SELECT symbol FROM p INTERSECT SELECT symbol FROM v) UNION ALL SELECT 'either', count(*) FROM (SELECT symbol FROM p UNION SELECT symbol FROM v)")
def set_operations(spark, sf_dir):
    """JOIN-18, 19, section 2.12."""
    p, v = V.trades(spark, sf_dir).select("symbol"), V.ticks(spark, sf_dir).where("kind = 'signup'").select("symbol")
    sets = {"only_trades": p.subtract(v), "both": p.intersect(v), "either": p.union(v).distinct()}
    out = None
    for name, s in sets.items():
        part = s.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {RANKS} SELECT ranking_type, snap_ms, symbol, amount FROM ranks WHERE ranking_type = 'events' ORDER BY amount DESC, symbol, snap_ms LIMIT 25")
def top_k(spark, sf_dir):
    """SIM-10: top rows by a composite key."""
    return V.rankings(spark, sf_dir).where("ranking_type = 'events'").select("ranking_type", "snap_ms", "symbol", "amount").orderBy(F.desc("amount"), "symbol", "snap_ms").limit(25)
