"""Registered queries of rule grids over price and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import resampling as B
from tidemark.operators import rules as G
from tidemark.operators.bars import ratio
from tidemark.plans.queries import DAY, HOUR, HOURS, RANKS, TICKS, doubles, hours, query, rounded
from tidemark.plans.resampling import COMPARED, ENDS, NUMBER, SEED, USES, quantiles
from tidemark.sources import views as V

HORIZON = 4 * DAY
W = G.When
RULES = (
    *[G.Rule(f"take{t}_stop{s}", (W("take", t), W("stop", s))) for t in (0.1, 0.3, 0.6) for s in (0.1, 0.3)],
    *[G.Rule(f"trail{t}", (W("trail", t),)) for t in (0.1, 0.2, 0.4)],
    *[G.Rule(f"held{h}h", (W("held", h * HOUR),)) for h in (12, 24, 48)],
    *[G.Rule(f"rank_worse{k}", (W("rank_worse", k),)) for k in (5, 20)],
    *[G.Rule(f"share_drop{p}", (W("share_drop", p),)) for p in (0.3, 0.6)],
    G.Rule("quiet", (W("quiet", 1),)),
    *[G.Rule(f"rank_worse20_stop{s}", (W("rank_worse", 20), W("stop", s))) for s in (0.1, 0.3)],
    G.Rule("take0.3_trail0.2_held48h", (W("take", 0.3), W("trail", 0.2), W("held", 48 * HOUR))),
    G.Rule("share_drop0.6_trail0.4", (W("share_drop", 0.6), W("trail", 0.4))),
    G.Rule("all", (W("take", 0.6), W("stop", 0.3), W("trail", 0.4), W("rank_worse", 20), W("share_drop", 0.6), W("held", 48 * HOUR))),
)

_SQL = {
    "stop": lambda b: (f"p.low_u <= entry_u * (1 - CAST({b} AS DOUBLE))", f"-CAST({b} AS DOUBLE)"),
    "take": lambda b: (f"p.high_u >= entry_u * (1 + CAST({b} AS DOUBLE))", f"CAST({b} AS DOUBLE)"),
    "trail": lambda b: (f"p.close_u <= peak * (1 - CAST({b} AS DOUBLE))", "close_ret"),
    "held": lambda b: (f"exit_ms - ts_ms >= {b}", "close_ret"),
    "rank_worse": lambda b: (f"p.rank - entry_rank >= {b}", "close_ret"),
    "share_drop": lambda b: (f"p.share <= entry_share * (1 - CAST({b} AS DOUBLE))", "close_ret"),
    "quiet": lambda b: (f"p.n <= {b}", "close_ret"),
}
_HITS = [
    f"struct_pack(rule := '{r.name}', hit := {_SQL[c.kind](c.bound)[0]}, at := {G.ORDER.index(c.kind)}, reason := '{c.kind}', ret := {_SQL[c.kind](c.bound)[1]})" for r in RULES for c in r.any_of
]
_NAMES = ", ".join(f"('{r.name}')" for r in RULES)
#: A bar knows the ranking of the day before it; every condition of every rule is looked at on every bar.
RULED = (
    RANKS
    + HOURS[len(TICKS) :]
    + f""", known AS (SELECT symbol, snap_ms, rank, amount / CAST(sum(amount) OVER (PARTITION BY snap_ms) AS DOUBLE) AS share FROM ranks WHERE ranking_type = 'events'),
 path AS (SELECT h.symbol, h.ts_ms, h.high_u, h.low_u, h.close_u, h.n, k.rank, k.share FROM hours h LEFT JOIN known k ON k.symbol = h.symbol AND k.snap_ms = (h.ts_ms - 1) // {DAY} * {DAY} - {DAY}),
 entries AS (SELECT t.event_id AS entry_id, t.symbol, t.ts_ms, t.price_u AS entry_u, k.rank AS entry_rank, k.share AS entry_share FROM trades t LEFT JOIN known k ON k.symbol = t.symbol AND k.snap_ms = t.ts_ms // {DAY} * {DAY} - {DAY} WHERE t.price_u > 0),
 p AS (SELECT e.*, h.ts_ms AS exit_ms, h.high_u, h.low_u, h.close_u, h.n, h.rank, h.share, h.close_u / CAST(e.entry_u AS DOUBLE) - 1 AS close_ret, greatest(e.entry_u, max(h.high_u) OVER (PARTITION BY e.entry_id ORDER BY h.ts_ms ROWS UNBOUNDED PRECEDING)) AS peak
  FROM entries e JOIN path h ON h.symbol = e.symbol AND h.ts_ms > e.ts_ms AND h.ts_ms <= e.ts_ms + {HORIZON}),
 looked AS (SELECT entry_id, exit_ms, unnest([{', '.join(_HITS)}]) AS x FROM p),
 first_hits AS (SELECT entry_id, x.rule AS rule, arg_min((exit_ms, x.reason, x.ret), (exit_ms, x.at)) AS f FROM looked WHERE x.hit GROUP BY ALL), ends AS (SELECT entry_id, max(exit_ms) AS exit_ms, arg_max(close_ret, exit_ms) AS ret FROM p GROUP BY entry_id),
 ruled AS (SELECT e.entry_id, e.ts_ms, r.rule, coalesce(f.f[1], l.exit_ms) AS exit_ms, coalesce(f.f[2], CASE WHEN l.entry_id IS NOT NULL THEN 'horizon' END) AS reason, coalesce(f.f[3], l.ret) AS ret
  FROM entries e CROSS JOIN (VALUES {_NAMES}) r(rule) LEFT JOIN first_hits f ON f.entry_id = e.entry_id AND f.rule = r.rule LEFT JOIN ends l ON l.entry_id = e.entry_id)"""
)


def entries_and_path(spark, sf_dir):
    ranks = V.rankings(spark, sf_dir).where("ranking_type = 'events'")
    share = ratio(F.col("amount"), F.sum("amount").over(Window.partitionBy("snap_ms")))
    known = ranks.select("symbol", F.col("snap_ms").alias("day"), "rank", share.alias("share"))
    before = lambda t: (F.floor(t / DAY) * DAY - DAY).cast("long")
    path = hours(spark, sf_dir).select("symbol", "ts_ms", "high_u", "low_u", "close_u", "n", before(F.col("ts_ms") - 1).alias("day")).join(known, ["symbol", "day"], "left").drop("day")
    trades = V.trades(spark, sf_dir).where("price_u > 0").withColumn("day", before(F.col("ts_ms"))).join(known, ["symbol", "day"], "left")
    return trades.select(F.col("event_id").alias("entry_id"), "symbol", "ts_ms", F.col("price_u").alias("entry_u"), F.col("rank").alias("entry_rank"), F.col("share").alias("entry_share")), path


@query(f"WITH {RULED} SELECT entry_id, rule, CAST(exit_ms AS DOUBLE) AS exit_ms, reason, round(ret, 6) AS ret FROM ruled")
def rule_results(spark, sf_dir):
    """SIM-08: every entry under twenty-two rules over price and signals, from one scan of its path."""
    entries, path = entries_and_path(spark, sf_dir)
    return rounded(doubles(G.evaluate_rules(entries, path, RULES, HORIZON), "exit_ms"), "ret")


@query(
    f"""WITH {RULED}, per AS (SELECT rule, ts_ms // {DAY} AS cluster, sum(ret) AS s, count(*) AS n FROM ruled WHERE ret IS NOT NULL GROUP BY ALL), {USES}, d AS (SELECT rule, draw, sum(k * s) / CAST(sum(k * n) AS DOUBLE) AS m FROM per JOIN uses USING (cluster) GROUP BY ALL HAVING sum(k * n) > 0),
 i AS (SELECT rule, {quantiles('m')} FROM d GROUP BY rule), whole AS (SELECT rule, sum(s) / CAST(sum(n) AS DOUBLE) AS mean, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_clusters FROM per GROUP BY rule), r AS (SELECT rule, round(mean, 6) AS mean, n, n_clusters, {ENDS} FROM whole JOIN i USING (rule))
 SELECT *, CAST(CASE WHEN n >= 30 THEN rank() OVER (PARTITION BY n >= 30 ORDER BY ci_low DESC NULLS LAST) END AS DOUBLE) AS place FROM r"""
)
def rule_ranking(spark, sf_dir):
    """SIM-08, 10: rules by the lower end of their mean's interval over days, equal ones sharing a place."""
    entries, path = entries_and_path(spark, sf_dir)
    results = G.evaluate_rules(entries, path, RULES, HORIZON).join(entries.select("entry_id", F.floor(F.col("ts_ms") / DAY).alias("day")), "entry_id")
    cuts = ("ci_low", "ci_high", "bonferroni_low", "bonferroni_high")
    means = rounded(B.bootstrap_mean(results, ["rule"], "day", "ret", NUMBER, SEED, COMPARED), "mean", *cuts)
    return doubles(G.ranked_rules(means, 30), "place")
