"""Registered queries of the cluster bootstraps; SQL draws by the same hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import resampling as R
from tidemark.plans.controls import DRAWN, outcomes
from tidemark.plans.queries import DAY, TICKS, hours, query, rounded
from tidemark.sources import views as V

NUMBER, SEED, COMPARED = 400, 7, 5
_U = f"(CAST('0x' || substr(md5(cluster || '-' || draw || '-{SEED}'), 1, 7) AS BIGINT) + 0.5) / 268435456.0"
#: (draw, cluster, k) of clusters (cluster).
USES = f"""uses AS (SELECT draw, cluster, {' + '.join(f'CAST(u > {p} AS INTEGER)' for p in R.POISSON)} AS k FROM (SELECT draw, cluster, {_U} AS u FROM (SELECT DISTINCT cluster FROM per), range(1, {NUMBER + 1}) r(draw)))"""
_CUTS = {"ci_low": 0.025, "ci_high": 0.975, "bonferroni_low": 0.025 / COMPARED, "bonferroni_high": 1 - 0.025 / COMPARED}


def quantiles(value: str) -> str:
    return ", ".join(f"quantile_cont({value}, {q}) AS {n}" for n, q in _CUTS.items())


ENDS = ", ".join(f"round(i.{n}, 6) AS {n}" for n in _CUTS) + ", " + ", ".join(f"i.{n}_low <= 0 AND i.{n}_high >= 0 AS {n}_holds_zero" for n in ("ci", "bonferroni"))


@query(
    f"""WITH {TICKS}, per AS (SELECT symbol AS cluster, sum(price_u) AS s, count(*) AS n FROM trades GROUP BY symbol), {USES}, d AS (SELECT draw, sum(k * s) / CAST(sum(k * n) AS DOUBLE) AS m FROM per JOIN uses USING (cluster) GROUP BY draw HAVING sum(k * n) > 0),
 i AS (SELECT {quantiles('m')} FROM d), p AS (SELECT sum(s) / CAST(sum(n) AS DOUBLE) AS mean, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_clusters FROM per) SELECT round(mean, 6) AS mean, n, n_clusters, {ENDS} FROM p CROSS JOIN i"""
)
def cluster_bootstrap(spark, sf_dir):
    """STAT-01: a mean over symbols with its interval, plain and for five comparisons."""
    return rounded(R.bootstrap_mean(V.trades(spark, sf_dir), [], "symbol", "price_u", NUMBER, SEED, COMPARED), "mean", *_CUTS)


@query(
    f"""WITH {DRAWN}, per AS (SELECT tolerance, ts_ms // {DAY} AS cluster, coalesce(sum(ret_end) FILTER (arm = 'real'), 0) AS s1, count(ret_end) FILTER (arm = 'real') AS n1, coalesce(sum(ret_end) FILTER (arm = 'control'), 0) AS s2, count(ret_end) FILTER (arm = 'control') AS n2
  FROM outc WHERE ret_end IS NOT NULL GROUP BY ALL HAVING count(ret_end) FILTER (arm = 'real') > 0 AND count(ret_end) FILTER (arm = 'control') > 0), {USES},
 d AS (SELECT tolerance, draw, sum(k * s1) / nullif(CAST(sum(k * n1) AS DOUBLE), 0) - sum(k * s2) / nullif(CAST(sum(k * n2) AS DOUBLE), 0) AS m FROM per JOIN uses USING (cluster) GROUP BY ALL), i AS (SELECT tolerance, {quantiles('m')} FROM d GROUP BY tolerance),
 p AS (SELECT tolerance, CAST(sum(n1) AS BIGINT) AS n_first, CAST(sum(n2) AS BIGINT) AS n_second, sum(s1) / CAST(sum(n1) AS DOUBLE) AS mean_first, sum(s2) / CAST(sum(n2) AS DOUBLE) AS mean_second, count(*) AS n_clusters FROM per GROUP BY tolerance)
 SELECT p.tolerance, n_first, n_second, round(mean_first, 6) AS mean_first, round(mean_second, 6) AS mean_second, n_clusters, round(mean_first - mean_second, 6) AS mean_diff, {ENDS} FROM p JOIN i USING (tolerance)"""
)
def bootstrap_difference(spark, sf_dir):
    """STAT-02: events less their controls, by tolerance, when days are drawn."""
    rows = outcomes(spark, sf_dir).withColumn("day", F.floor(F.col("ts_ms") / DAY))
    out = R.bootstrap_difference(rows, ["tolerance"], "day", F.col("arm") == "real", "ret_end", NUMBER, SEED, COMPARED)
    return rounded(out, "mean_first", "mean_second", "mean_diff", *_CUTS)


_SOLVED = """CASE WHEN full_rank THEN (szz * sxy - sxz * szy) / det WHEN trace > 0 THEN (sxx * sxy + sxz * szy) / (trace * trace) ELSE 0 END AS beta_x, CASE WHEN full_rank THEN (sxx * szy - sxz * sxy) / det WHEN trace > 0 THEN (sxz * sxy + szz * szy) / (trace * trace) ELSE 0 END AS beta_z"""


def _solved(table: str) -> str:
    return f"(SELECT *, (dy - dx * beta_x - dz * beta_z) / g AS estimate FROM (SELECT *, {_SOLVED} FROM (SELECT *, det > 1e-12 * trace * trace AS full_rank FROM (SELECT *, sxx * szz - sxz * sxz AS det, sxx + szz AS trace FROM {table}))))"


_NINE = "g sxx sxz szz sxy szy dx dz dy".split()


@query(
    f"""WITH {DRAWN}, feats AS (SELECT o.tolerance, o.event_id, o.arm, o.ts_ms // {DAY} AS cluster, ln(h.n + 1) AS x, ln(h.high_u / CAST(h.low_u AS DOUBLE)) AS z, o.ret_max AS y FROM outc o JOIN hours h ON h.symbol = o.symbol AND h.ts_ms = o.bar_ms WHERE o.ret_max IS NOT NULL AND h.low_u > 0),
 grp AS (SELECT tolerance, event_id, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) AS sxx, covar_pop(x, z) AS sxz, covar_pop(z, z) AS szz, covar_pop(x, y) AS sxy, covar_pop(z, y) AS szy FROM feats WHERE arm = 'control' GROUP BY ALL),
 per AS (SELECT f.tolerance, f.cluster, count(*) AS g, sum(sxx) AS sxx, sum(sxz) AS sxz, sum(szz) AS szz, sum(sxy) AS sxy, sum(szy) AS szy, sum(x - mx) AS dx, sum(z - mz) AS dz, sum(y - my) AS dy FROM feats f JOIN grp USING (tolerance, event_id) WHERE f.arm = 'real' GROUP BY ALL), {USES},
 whole AS (SELECT tolerance, count(*) AS n_clusters, {', '.join(f'sum({c}) AS {c}' for c in _NINE)} FROM per GROUP BY tolerance),
 draws AS (SELECT tolerance, draw, {', '.join(f'sum(k * {c}) AS {c}' for c in _NINE)} FROM per JOIN uses USING (cluster) WHERE k > 0 GROUP BY ALL),
 i AS (SELECT tolerance, {quantiles('estimate')} FROM {_solved('draws')} GROUP BY tolerance)
 SELECT p.tolerance, CAST(p.g AS BIGINT) AS n_events, p.n_clusters, round(p.beta_x, 6) AS beta_x, round(p.beta_z, 6) AS beta_z, CASE WHEN full_rank THEN 2 WHEN trace > 0 THEN 1 ELSE 0 END AS rank, round(p.estimate, 6) AS estimate, {ENDS} FROM {_solved('whole')} p JOIN i USING (tolerance)"""
)
def within_group_regression(spark, sf_dir):
    """STAT-03: events against what their controls' prints and range predict, slopes shared by all events, when days are drawn."""
    bar = hours(spark, sf_dir).where("low_u > 0").select("symbol", F.col("ts_ms").alias("bar_ms"), F.log(F.col("n") + 1).alias("x"), F.log(F.col("high_u") / F.col("low_u")).alias("z"))
    rows = outcomes(spark, sf_dir).join(bar, ["symbol", "bar_ms"]).withColumn("day", F.floor(F.col("ts_ms") / DAY)).withColumnRenamed("ret_max", "y")
    events, controls = rows.where("arm = 'real'").select("tolerance", "event_id", "day", "x", "z", "y"), rows.where("arm = 'control'").select("tolerance", "event_id", "x", "z", "y")
    out = R.within_group_regression(events, controls, ["tolerance"], "event_id", "day", "x", "z", "y", NUMBER, SEED, COMPARED)
    return rounded(out, "beta_x", "beta_z", "estimate", *_CUTS)
