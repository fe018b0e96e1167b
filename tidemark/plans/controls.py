"""Registered queries of matched controls, paired tests and decision tables; they join those of tidemark.plans.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import controls as C
from tidemark.operators import stats as A
from tidemark.operators.bars import ratio
from tidemark.plans.queries import DAY, FLOW, HOURS, TICKS, flow, hours, query, rounded
from tidemark.sources import views as V

TOLERANCES, DRAWS = (0.1, 0.25), 3

DRAWN = (
    HOURS
    + f""", ce AS (SELECT event_id, symbol, ts_ms, price_u FROM trades WHERE price_u > 0),
 cp AS (SELECT e.event_id, e.symbol, h.ts_ms AS control_ms, CAST(v.t AS DOUBLE) AS tolerance FROM ce e JOIN hours h ON h.symbol = e.symbol AND h.close_u > 0 AND abs(h.ts_ms - e.ts_ms) > {DAY}, (VALUES (0.1), (0.25)) v(t)
 WHERE CAST(greatest(h.close_u, e.price_u) AS DOUBLE) <= CAST(least(h.close_u, e.price_u) AS DOUBLE) * (1 + CAST(v.t AS DOUBLE))),
 cd AS (SELECT *, count(*) OVER (PARTITION BY event_id, tolerance) AS n_pool, row_number() OVER (PARTITION BY event_id, tolerance ORDER BY md5(event_id || '-' || control_ms || '-0'), control_ms) AS draw FROM cp),
 drawn AS (SELECT * FROM cd WHERE draw <= {DRAWS}),
 arms AS (SELECT e.event_id, d.tolerance, 'real' AS arm, 0 AS draw, e.symbol, e.ts_ms FROM ce e JOIN (SELECT DISTINCT event_id, tolerance FROM drawn) d USING (event_id)
 UNION ALL SELECT event_id, tolerance, 'control', draw, symbol, control_ms FROM drawn),
 fwd AS (SELECT symbol, ts_ms, close_u, last_value(close_u) OVER w / nullif(CAST(close_u AS DOUBLE), 0) - 1 AS ret_end, max(high_u) OVER w / nullif(CAST(close_u AS DOUBLE), 0) - 1 AS ret_max FROM hours
 WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN 1 FOLLOWING AND {3 * DAY} FOLLOWING)),
 outc AS (SELECT a.*, f.ts_ms AS bar_ms, f.close_u, f.ret_end, f.ret_max FROM arms a ASOF LEFT JOIN fwd f ON a.symbol = f.symbol AND a.ts_ms >= f.ts_ms)"""
)


def real_events(spark, sf_dir):
    return V.trades(spark, sf_dir).where("price_u > 0").select("event_id", "symbol", "ts_ms", F.col("price_u").alias("close_u"))


def drawn(spark, sf_dir):
    return C.draw_controls(real_events(spark, sf_dir), hours(spark, sf_dir), "close_u", TOLERANCES, DAY, DRAWS)


def outcomes(spark, sf_dir):
    arms = C.arms(real_events(spark, sf_dir), drawn(spark, sf_dir))
    return C.forward_outcomes(arms, hours(spark, sf_dir), 3 * DAY)


@query(f"WITH {DRAWN} SELECT event_id, tolerance, CAST(draw AS INTEGER) AS draw, symbol, control_ms, n_pool FROM drawn")
def control_draws(spark, sf_dir):
    """STAT-14..17, FLT-22, 24: control bars of near price drawn for each trade, at two tolerances."""
    return drawn(spark, sf_dir)


@query(
    f"""WITH {DRAWN} SELECT tolerance, arm, count(*) AS n, count(ret_end) AS n_known, round(avg(ret_end), 6) AS mean_end, round(quantile_cont(ret_max, 0.5), 6) AS median_max FROM outc GROUP BY ALL"""
)
def arm_outcomes(spark, sf_dir):
    """STAT-18, EVT-17, AGG-28: the same forward probe on events and on their controls."""
    out = outcomes(spark, sf_dir).groupBy("tolerance", "arm").agg(F.count("*").alias("n"), F.count("ret_end").alias("n_known"), F.avg("ret_end").alias("mean_end"), F.percentile("ret_max", 0.5).alias("median_max"))
    return rounded(out, "mean_end", "median_max")


PAIRS = """ps AS (SELECT tolerance, event_id, avg(ret_end) FILTER (arm = 'real') AS a, avg(ret_end) FILTER (arm = 'control') AS b FROM outc GROUP BY ALL),
 pd AS (SELECT tolerance, count(*) AS n_pairs, avg(a) AS real_mean, avg(b) AS control_mean, avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd_diff FROM ps WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY tolerance)"""


@query(
    f"""WITH {DRAWN}, {PAIRS} SELECT tolerance, n_pairs, round(real_mean, 6) AS real_mean, round(control_mean, 6) AS control_mean, round(mean_diff, 6) AS mean_diff, round(sd_diff, 6) AS sd_diff,
 round(mean_diff - 1.96 * sd_diff / sqrt(n_pairs), 6) AS low, round(mean_diff + 1.96 * sd_diff / sqrt(n_pairs), 6) AS high FROM pd"""
)
def paired_ladder(spark, sf_dir):
    """STAT-05, 19: differences of events and their averaged controls, by tolerance, with intervals."""
    out = C.paired_differences(outcomes(spark, sf_dir), ["tolerance"], "ret_end")
    return rounded(out, "real_mean", "control_mean", "mean_diff", "sd_diff", "low", "high")


@query(
    f"""WITH {DRAWN}, l AS (SELECT tolerance, arm, 'close_u' AS "column", CAST(close_u AS DOUBLE) AS x FROM outc UNION ALL SELECT tolerance, arm, 'bar_ms', CAST(bar_ms AS DOUBLE) FROM outc UNION ALL SELECT tolerance, arm, 'ret_max', ret_max FROM outc),
 g AS (SELECT tolerance, "column", avg(x) FILTER (arm = 'real') AS a, avg(x) FILTER (arm = 'control') AS b, var_samp(x) FILTER (arm = 'real') AS va, var_samp(x) FILTER (arm = 'control') AS vb FROM l GROUP BY ALL)
 SELECT tolerance, "column", round((a - b) / nullif(sqrt((va + vb) / 2), 0), 5) AS std_diff FROM g"""
)
def control_balance(spark, sf_dir):
    """STAT-20: whether controls resemble their events in price, time and what follows."""
    return C.balance(outcomes(spark, sf_dir), ["tolerance"], ["close_u", "bar_ms", "ret_max"]).select("tolerance", "column", F.round("std_diff", 5).alias("std_diff"))


@query(
    f"""WITH {DRAWN}, {PAIRS}, i AS (SELECT *, mean_diff - 1.96 * sd_diff / sqrt(n_pairs) AS low, mean_diff + 1.96 * sd_diff / sqrt(n_pairs) AS high FROM pd), v AS (SELECT b.mean_diff AS b, b.low AS bl, b.high AS bh, c.mean_diff AS c, c.low AS cl, c.high AS ch FROM i b, i c WHERE b.tolerance = 0.1 AND c.tolerance = 0.25),
 w AS (SELECT *, l AS line, coalesce(bl > l, false) AS bc, coalesce(cl > l, false) AS cc, coalesce(b > 0 AND c > 0 AND c BETWEEN bl AND bh AND b BETWEEN cl AND ch, false) AS ag FROM v, (VALUES (CAST(-1 AS DOUBLE)), (0), (0.05)) x(l))
 SELECT CAST(line AS DOUBLE) AS line, CASE WHEN bc AND ag THEN 'clears_agrees' WHEN bc AND coalesce(c <= 0 OR (c < b AND NOT ag), false) THEN 'clears_killed' WHEN bc THEN 'clears_disagrees' WHEN cc THEN 'misses_finding_only' ELSE 'both_miss' END AS cell, CASE WHEN bc AND ag THEN round(b, 6) END AS quoted FROM w"""
)
def decision_table(spark, sf_dir):
    """STAT-04: verdicts on two estimates of one effect, for several lines to pass."""
    ladder = C.paired_differences(outcomes(spark, sf_dir), ["tolerance"], "ret_end")
    at = lambda t, p: ladder.where(F.col("tolerance") == t).select(*[F.col(c).alias(f"{p}{n}") for c, n in (("mean_diff", ""), ("low", "_low"), ("high", "_high"))])
    both = at(0.1, "b").crossJoin(F.broadcast(at(0.25, "c")))  # one row each
    out = None
    for line in (-1.0, 0.0, 0.05):
        cell = C.verdict("b", "b_low", "b_high", "c", "c_low", "c_high", line)
        part = both.select(F.lit(line).alias("line"), cell.alias("cell"), F.when(cell == "clears_agrees", F.round("b", 6)).alias("quoted"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {FLOW}, v AS (SELECT symbol, start_ms, imbalance, ret_bp FROM flow WHERE imbalance IS NOT NULL AND ret_bp IS NOT NULL),
 a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_ms) AS k, row_number() OVER (PARTITION BY symbol ORDER BY md5(symbol || '-' || start_ms || '-1'), start_ms) AS p FROM v)
 SELECT count(*) AS n, round(corr(a.imbalance, a.ret_bp), 6) AS corr_real, round(corr(a.imbalance, b.ret_bp), 6) AS corr_placebo FROM a JOIN a b ON a.symbol = b.symbol AND a.k = b.p"""
)
def permuted_pairs(spark, sf_dir):
    """STAT-08: a correlation beside that of the same values exchanged within each symbol."""
    v = flow(spark, sf_dir).where("imbalance is not null and ret_bp is not null").select("symbol", "start_ms", "imbalance", "ret_bp")
    w = Window.partitionBy("symbol")
    order = C.shuffled(F.concat_ws("-", F.col("symbol").cast("string"), F.col("start_ms").cast("string")), 1)
    a = v.withColumn("k", F.row_number().over(w.orderBy("start_ms")))
    b = v.select("symbol", F.col("ret_bp").alias("other"), F.row_number().over(w.orderBy(order, "start_ms")).alias("k"))
    out = a.join(b, ["symbol", "k"]).agg(F.count("*").alias("n"), F.corr("imbalance", "ret_bp").alias("corr_real"), F.corr("imbalance", "other").alias("corr_placebo"))
    return rounded(out, "corr_real", "corr_placebo")


def _edges_sql(c: str, n: int, p: str) -> str:
    cuts = ", ".join(f"quantile_cont({c}, {k / n})" for k in range(1, n))
    return f"{p} AS (SELECT list_distinct([{cuts}]) AS {p}_e, min({c}) AS {p}_lo, max({c}) AS {p}_hi FROM sv)"


@query(
    f"""WITH {FLOW}, sv AS (SELECT n AS x, ret_bp AS y, next_ret_bp AS z FROM flow WHERE ret_bp IS NOT NULL), {_edges_sql("x", 3, "xe")}, {_edges_sql("y", 4, "ye")},
 k AS (SELECT z, len(list_filter(xe_e, lambda e: e > xe_lo AND e < xe_hi AND e < x)) AS bin_x, len(list_filter(ye_e, lambda e: e > ye_lo AND e < ye_hi AND e < y)) AS bin_y FROM sv, xe, ye)
 SELECT CAST(bin_x AS INTEGER) AS bin_x, CAST(bin_y AS INTEGER) AS bin_y, count(*) AS n, round(avg(z), 4) AS next_bp, count(z) >= 30 AS powered FROM k GROUP BY bin_x, bin_y"""
)
def surface(spark, sf_dir):
    """STAT-10: next returns over the quantiles of two features, and which cells have enough rows."""
    v = flow(spark, sf_dir).where("ret_bp is not null").withColumn("x", F.col("n").cast("double"))
    both = A.bucketed(A.bucketed(v, "x", 3, "bin_x"), "ret_bp", 4, "bin_y")
    out = both.groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"), F.avg("next_ret_bp").alias("next_bp"), (F.count("next_ret_bp") >= 30).alias("powered"))
    return rounded(out, "next_bp", digits=4)


@query(
    f"""WITH {FLOW}, g AS (SELECT symbol, count(*) AS n, count(*) FILTER (ret_bp > 0) AS k FROM flow GROUP BY symbol), sv AS (SELECT n AS x, k FROM g), {_edges_sql("x", 4, "xe")},
 b AS (SELECT len(list_filter(xe_e, lambda e: e > xe_lo AND e < xe_hi AND e < x)) AS bucket, x, k FROM sv, xe), r AS (SELECT bucket, count(*) AS n_symbols, sum(k) / CAST(sum(x) AS DOUBLE) AS rate FROM b GROUP BY bucket)
 SELECT CAST(bucket AS INTEGER) AS bucket, n_symbols, round(rate, 6) AS rate, coalesce(rate >= lag(rate) OVER (ORDER BY bucket), true) AS rising FROM r"""
)
def density_independence(spark, sf_dir):
    """STAT-12: whether a rate of detection follows how densely a symbol trades."""
    g = flow(spark, sf_dir).groupBy("symbol").agg(F.count("*").cast("double").alias("x"), F.count_if(F.col("ret_bp") > 0).alias("k"))
    r = A.bucketed(g, "x", 4).groupBy("bucket").agg(F.count("*").alias("n_symbols"), ratio(F.sum("k"), F.sum("x")).alias("rate"))
    rising = F.coalesce(F.col("rate") >= F.lag("rate").over(Window.orderBy("bucket")), F.lit(True))  # one row a bucket
    return rounded(r.withColumn("rising", rising), "rate")


@query(
    f"""WITH {TICKS}, g AS (SELECT kind, count(*) AS n, stddev_samp(price_u / 1000000.0) AS sd, count(DISTINCT ts_ms // {DAY}) AS days FROM ticks GROUP BY kind)
 SELECT kind, round(sd, 4) AS sd, CAST(ceil(greatest(30.0, pow(1.96 * sd / 0.5, 2)) / (n / CAST(days AS DOUBLE))) AS DOUBLE) AS days_needed FROM g"""
)
def required_days(spark, sf_dir):
    """STAT-26: how many days of data each kind of print needs for a mean known to half a dollar."""
    g = V.ticks(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.stddev_samp(F.col("price_u") / 1e6).alias("sd"), F.countDistinct(F.floor(F.col("ts_ms") / DAY)).alias("days"))
    return g.select("kind", F.round("sd", 4).alias("sd"), C.days_needed(F.col("sd"), 0.5, F.col("n") / F.col("days")).cast("double").alias("days_needed"))


@query(
    f"""WITH {DRAWN}, r AS (SELECT f.*, row_number() OVER (PARTITION BY symbol ORDER BY md5(symbol || '-' || ts_ms || '-2'), ts_ms) AS k FROM fwd f), b AS (SELECT * FROM r WHERE k <= 20), e AS (SELECT symbol, avg(ret_end) AS a, count(ret_end) AS n FROM outc WHERE arm = 'real' AND tolerance = 0.25 GROUP BY symbol),
 s AS (SELECT symbol, avg(ret_end) AS b FROM b GROUP BY symbol) SELECT count(*) AS n_symbols, round(avg(a), 6) AS event_mean, round(avg(b), 6) AS random_mean, round(avg(a - b), 6) AS symbol_gap, round(sum((a - b) * n) / sum(n), 6) AS row_gap FROM e JOIN s USING (symbol) WHERE a IS NOT NULL AND b IS NOT NULL"""
)
def random_baseline(spark, sf_dir):
    """STAT-23, 24: events against twenty bars of each symbol drawn at random, by symbols and by rows."""
    w = Window.partitionBy("symbol").orderBy("ts_ms").rangeBetween(1, 3 * DAY)
    bars = hours(spark, sf_dir).select("symbol", "ts_ms", (ratio(F.last("close_u").over(w), F.col("close_u")) - 1).alias("r"))
    order = C.shuffled(F.concat_ws("-", F.col("symbol").cast("string"), F.col("ts_ms").cast("string")), 2)
    some = bars.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(order, "ts_ms"))).where("k <= 20").groupBy("symbol").agg(F.avg("r").alias("b"))
    real = outcomes(spark, sf_dir).where("arm = 'real' and tolerance = 0.25").groupBy("symbol").agg(F.avg("ret_end").alias("a"), F.count("ret_end").alias("n"))
    both = real.join(some, "symbol").where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    out = both.agg(F.count("*").alias("n_symbols"), F.avg("a").alias("event_mean"), F.avg("b").alias("random_mean"), F.avg("d").alias("symbol_gap"), F.try_divide(F.sum(F.col("d") * F.col("n")), F.sum("n")).alias("row_gap"))
    return rounded(out, "event_mean", "random_mean", "symbol_gap", "row_gap")


@query(
    f"""WITH {HOURS}, a AS (SELECT 'rows' AS check_name, CAST(sum(n) AS DOUBLE) AS old, (SELECT CAST(count(*) AS DOUBLE) FROM ticks) AS new FROM hours UNION ALL SELECT 'volume', CAST(sum(vol_qu) AS DOUBLE), (SELECT CAST(sum(qty_u) AS DOUBLE) FROM ticks) FROM hours
 UNION ALL SELECT 'symbols', CAST(count(DISTINCT symbol) AS DOUBLE), (SELECT CAST(count(DISTINCT symbol) AS DOUBLE) FROM trades) FROM hours) SELECT *, old = new AS reproduced FROM a"""
)
def reproduction_check(spark, sf_dir):
    """STAT-22: figures that two ways of counting must share, and one that they need not."""
    bars, ticks = hours(spark, sf_dir), V.ticks(spark, sf_dir)
    d = lambda c: c.cast("double")
    old = bars.agg(d(F.sum("n")).alias("rows"), d(F.sum("vol_qu")).alias("volume"), d(F.countDistinct("symbol")).alias("symbols"))
    new = ticks.agg(d(F.count("*")).alias("rows2"), d(F.sum("qty_u")).alias("volume2"), d(F.countDistinct(F.when(F.col("kind") == "purchase", F.col("symbol")))).alias("symbols2"))
    checks = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("old"), F.col(f"{n}2").alias("new")) for n in ("rows", "volume", "symbols")])
    return old.crossJoin(F.broadcast(new)).select(F.inline(checks)).withColumn("reproduced", F.col("old") == F.col("new"))  # one row each


@query(
    f"""WITH {HOURS}, c AS (SELECT symbol, (ts_ms - 1) // {DAY} AS d, max(high_u) / nullif(CAST(min(low_u) AS DOUBLE), 0) - 1 AS by_bars FROM hours GROUP BY ALL), t AS (SELECT symbol, (ts_ms) // {DAY} AS d, max(price_u) / nullif(CAST(min(price_u) AS DOUBLE), 0) - 1 AS by_prints FROM trades GROUP BY ALL)
 SELECT t.d AS day, count(*) AS n, round(quantile_cont(by_bars - by_prints, 0.5), 6) AS median_delta, round(avg(CASE WHEN by_bars >= by_prints THEN 1.0 ELSE 0.0 END), 6) AS share_wider FROM c JOIN t USING (symbol, d) WHERE by_bars IS NOT NULL AND by_prints IS NOT NULL GROUP BY t.d"""
)
def ruler_bias(spark, sf_dir):
    """STAT-28: how a day's range by bars differs from its range by trades."""
    spread = lambda hi, lo: ratio(F.max(hi), F.min(lo)) - 1
    by_bars = hours(spark, sf_dir).groupBy("symbol", F.floor((F.col("ts_ms") - 1) / DAY).alias("day")).agg(spread("high_u", "low_u").alias("a"))
    by_prints = V.trades(spark, sf_dir).groupBy("symbol", F.floor(F.col("ts_ms") / DAY).alias("day")).agg(spread("price_u", "price_u").alias("b"))
    both = by_bars.join(by_prints, ["symbol", "day"]).where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    return rounded(both.groupBy("day").agg(F.count("*").alias("n"), F.percentile("d", 0.5).alias("median_delta"), F.avg((F.col("d") >= 0).cast("double")).alias("share_wider")), "median_delta", "share_wider")
