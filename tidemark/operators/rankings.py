"""Operators on ranking snapshots (snap_ms, ranking_type, rank, symbol)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import ratio
from tidemark.operators.ordered import mean_ranks
from tidemark.operators.rounds import settled
from tidemark.operators.temporal import range_pairs


def best_rank(rankings: DataFrame) -> DataFrame:
    """One row for each list, snapshot and symbol: its best rank."""
    return rankings.groupBy("ranking_type", "snap_ms", "symbol").agg(F.min("rank").alias("rank"))


def numbered(rankings: DataFrame) -> DataFrame:
    """best_rank with idx: the number of the snapshot in its list, from 1, and n_snaps. Numbers are made from the
    distinct snapshots alone, one row each."""
    ranks = best_rank(rankings)
    w = Window.partitionBy("ranking_type").orderBy("snap_ms")
    snaps = ranks.select("ranking_type", "snap_ms").distinct().withColumn("idx", F.row_number().over(w)).withColumn("n_snaps", F.count("*").over(Window.partitionBy("ranking_type")))
    return ranks.join(snaps, ["ranking_type", "snap_ms"])


def _presence(rankings: DataFrame, top: int) -> tuple[DataFrame, Window]:
    return numbered(rankings).where(F.col("rank") <= top), Window.partitionBy("ranking_type", "symbol").orderBy("idx")


def new_entries(rankings: DataFrame, top: int) -> DataFrame:
    """Symbols in the top now and not in the snapshot before; the first snapshot has none."""
    inside, w = _presence(rankings, top)
    return inside.withColumn("__p", F.lag("idx").over(w)).where("idx > 1 and (__p is null or __p < idx - 1)").select("ranking_type", "snap_ms", "symbol", "rank")


def rank_jumps(rankings: DataFrame, by: int) -> DataFrame:
    """Improvements by at least `by` between consecutive snapshots that both hold the symbol."""
    w = Window.partitionBy("ranking_type", "symbol").orderBy("idx")
    out = numbered(rankings).withColumn("__i", F.lag("idx").over(w)).withColumn("from_rank", F.lag("rank").over(w))
    return out.where((F.col("__i") == F.col("idx") - 1) & (F.col("from_rank") - F.col("rank") >= by)).select("ranking_type", "snap_ms", "symbol", "from_rank", "rank")


def dwell_starts(rankings: DataFrame, top: int, snaps: int) -> DataFrame:
    """New entries with run_length, how many snapshots they stay; those that leave sooner than `snaps` go, those that the
    end of the data cuts short are marked censored."""
    inside, w = _presence(rankings, top)
    runs = inside.withColumn("__run", F.col("idx") - F.row_number().over(w))
    found = runs.groupBy("ranking_type", "symbol", "__run").agg(F.min("snap_ms").alias("snap_ms"), F.min("idx").alias("start"), F.count("*").alias("run_length"), F.max("n_snaps").alias("n"))
    censored = (F.col("start") + F.col("run_length") - 1 >= F.col("n")) & (F.col("run_length") < snaps)
    return found.where((F.col("start") > 1) & ((F.col("run_length") >= snaps) | censored)).select("ranking_type", "snap_ms", "symbol", "run_length", censored.alias("censored"))


def top_changes(rankings: DataFrame, top: int) -> DataFrame:
    """(ranking_type, snap_ms, symbol, event, rank): who entered the top, and who left it (without a rank)."""
    inside, w = _presence(rankings, top)
    entered = new_entries(rankings, top).withColumn("event", F.lit("enter"))
    snaps = inside.select("ranking_type", F.col("idx").alias("__idx"), F.col("snap_ms").alias("__ms")).distinct()
    gone = inside.withColumn("__n", F.lead("idx").over(w)).where("__n is null or __n > idx + 1").select("ranking_type", "symbol", (F.col("idx") + 1).alias("__idx"))
    left = gone.join(snaps, ["ranking_type", "__idx"]).select("ranking_type", F.col("__ms").alias("snap_ms"), "symbol", F.lit(None).cast("int").alias("rank"), F.lit("exit").alias("event"))
    return entered.unionByName(left).select("ranking_type", "snap_ms", "symbol", "event", "rank")


def handoffs(changes: DataFrame, within_ms: int) -> DataFrame:
    """Exits and the entries of other symbols that follow in [0, within) of the same list."""
    out = changes.where("event = 'exit'").select("ranking_type", F.col("snap_ms").alias("exit_ms"), F.col("symbol").alias("exit_symbol"))
    into = changes.where("event = 'enter'").select("ranking_type", F.col("snap_ms").alias("exit_ms"), F.col("symbol").alias("enter_symbol"))
    pairs = range_pairs(out, into, "ranking_type", "exit_ms", -1, within_ms - 1)
    return pairs.where("exit_symbol <> r_enter_symbol").select("ranking_type", "exit_symbol", F.col("r_enter_symbol").alias("enter_symbol"), "exit_ms", F.col("r_exit_ms").alias("enter_ms"))


def rotation_scores(prints: DataFrame, at_ms: int, width_ms: int, min_prints: int, min_cohort: int) -> DataFrame:
    """Of symbols with min_prints or more in both windows before at_ms: shares of the cohort's amount, their change, and
    percentiles of the changes of share and rank within the cohort. A smaller cohort than min_cohort gives no rows."""
    recent = F.col("ts_ms") >= at_ms - width_ms
    both = prints.where((F.col("ts_ms") >= at_ms - 2 * width_ms) & (F.col("ts_ms") < at_ms)).groupBy("symbol").agg(
        F.count_if(recent).alias("n_prints"), F.count_if(~recent).alias("n_prints_prev"), F.sum(F.when(recent, F.col("amount")).otherwise(0)).alias("amount"), F.sum(F.when(~recent, F.col("amount")).otherwise(0)).alias("amount_prev")
    )
    cohort = both.where((F.col("n_prints") >= min_prints) & (F.col("n_prints_prev") >= min_prints))
    sums = cohort.agg(F.count("*").alias("__n"), F.sum("amount").alias("__all"), F.sum("amount_prev").alias("__all_prev"))
    out = cohort.crossJoin(F.broadcast(sums)).where(F.col("__n") >= min_cohort)  # one row
    out = out.withColumn("share_delta", ratio(F.col("amount"), F.col("__all")) - ratio(F.col("amount_prev"), F.col("__all_prev")))
    out = settled(out)  # one row a symbol, ranked in four ways
    for value, name in (("amount", "__now"), ("amount_prev", "__then")):
        out = mean_ranks(out, value, name, descending=True)
    out = settled(out.withColumn("rank_delta", F.col("__then") - F.col("__now")))
    for value in ("share_delta", "rank_delta"):
        out = mean_ranks(out, value, f"{value}_pct").withColumn(f"{value}_pct", F.col(f"{value}_pct") / F.col("__n"))
    return out.drop("__n", "__all", "__all_prev", "__now", "__then")


def amount_shares(rankings: DataFrame, top: int) -> DataFrame:
    """Each ranked symbol's share of its snapshot's amount within the top."""
    inside = rankings.where(F.col("rank") <= top)
    w = Window.partitionBy("ranking_type", "snap_ms")
    return inside.withColumn("share", ratio(F.col("amount"), F.sum("amount").over(w)))
