"""Exit rules over price and signals together: every rule of a grid is judged in one scan of each entry's path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.temporal import range_pairs


@dataclass(frozen=True)
class When:
    """One condition: `kind` with its bound; what it takes of the path is said in PREDICATES."""

    kind: str
    bound: float


@dataclass(frozen=True)
class Rule:
    """Leave at the first bar at which any of the conditions holds."""

    name: str
    any_of: tuple[When, ...]


#: Conditions of one bar are looked at in this order: the bad case first.
ORDER = ("stop", "take", "trail", "held", "rank_worse", "share_drop", "quiet")
_E, _P = (lambda c: F.col(f"__path.{c}")), F.col
PREDICATES = {
    "stop": lambda b: _E("low_u") <= _P("entry_u") * (1 - b),
    "take": lambda b: _E("high_u") >= _P("entry_u") * (1 + b),
    "trail": lambda b: _E("close_u") <= _P("__peak") * (1 - b),
    "held": lambda b: _E("ts_ms") - _P("ts_ms") >= b,
    "rank_worse": lambda b: _E("rank") - _P("entry_rank") >= b,
    "share_drop": lambda b: _E("share") <= _P("entry_share") * (1 - b),
    "quiet": lambda b: _E("n") <= b,
}


def _result(c: When) -> Column:
    """The return that a condition's exit gives: stops and targets at their price, all else at the close."""
    return F.lit(-c.bound) if c.kind == "stop" else F.lit(c.bound) if c.kind == "take" else _E("close_u") / F.col("entry_u") - 1


def evaluate_rules(entries: DataFrame, path: DataFrame, rules: tuple[Rule, ...], horizon_ms: int) -> DataFrame:
    """(entry_id, rule, exit_ms, reason, ret) for every entry and rule.

    entries: (entry_id, symbol, ts_ms, entry_u, entry_rank, entry_share); path: bars (symbol, ts_ms, high_u, low_u, close_u, n,
    rank, share) of which those in (ts, ts + horizon] count. An entry meets its path once; each condition's first bar is a
    minimum of structs, so all rules come out of one aggregate. What no condition ends leaves at the last bar's close, with
    the reason 'horizon'; an entry without a bar has nulls. Null signals meet no condition; of equal bars the stop comes first."""
    pairs = range_pairs(entries, path.select("symbol", "ts_ms", F.struct("ts_ms", "high_u", "low_u", "close_u", "n", "rank", "share").alias("path")), "symbol", "ts_ms", 0, horizon_ms).withColumnRenamed("r_path", "__path")
    seen = pairs.withColumn("__peak", F.greatest("entry_u", F.max(_E("high_u")).over(Window.partitionBy("entry_id").orderBy(_E("ts_ms")).rowsBetween(Window.unboundedPreceding, 0))))
    conditions = sorted({c for r in rules for c in r.any_of}, key=lambda c: (ORDER.index(c.kind), c.bound))
    at = {c: k for k, c in enumerate(conditions)}
    hits = [F.min(F.when(PREDICATES[c.kind](c.bound), F.struct(_E("ts_ms").alias("exit_ms"), F.lit(k).alias("at"), F.lit(c.kind).alias("reason"), _result(c).alias("ret")))).alias(f"c{k}") for c, k in at.items()]
    last = F.max(F.struct(_E("ts_ms").alias("exit_ms"), F.lit(len(at)).alias("at"), F.lit("horizon").alias("reason"), (_E("close_u") / F.col("entry_u") - 1).alias("ret"))).alias("last")
    first = seen.groupBy("entry_id").agg(*hits, last)
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.array_min(F.array(*[F.coalesce(f"c{at[c]}", "last") for c in r.any_of])).alias("exit")) for r in rules])
    told = first.select("entry_id", F.inline(each)).select("entry_id", "rule", "exit.exit_ms", "exit.reason", "exit.ret")
    names = F.explode(F.array(*[F.lit(r.name) for r in rules]))
    return entries.select("entry_id", names.alias("rule")).join(told, ["entry_id", "rule"], "left")


def ranked_rules(summary: DataFrame, least: int, by: str = "ci_low") -> DataFrame:
    """summary (rule, n, ..., by) with `place`: rules with at least `least` results by descending `by`, equal ones sharing the
    better place; the others, and those without an interval, have none. One row a rule."""
    fit = (F.col("n") >= least) & F.col(by).isNotNull()
    place = F.rank().over(Window.partitionBy(fit).orderBy(F.desc_nulls_last(by)))
    return summary.withColumn("place", F.when(fit, place))
