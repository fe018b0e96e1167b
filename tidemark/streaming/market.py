"""Structured Streaming forms of the stateful operators; each gives over a finished stream what its batch form gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(prints: DataFrame, delay: str, time: str = "ts_ms") -> DataFrame:
    """prints with a watermark on `event_time`, made from epoch milliseconds."""
    return prints.withColumn("event_time", F.timestamp_millis(F.col(time))).withWatermark("event_time", delay)


def deduplicated(prints: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Prints of overlapping polls, each once: state is kept for as long as the watermark allows repeats."""
    return with_event_time(prints, delay).dropDuplicatesWithinWatermark(keys)


def streamed_bars(prints: DataFrame, width: str, order: list[str], delay: str = "10 minutes") -> DataFrame:
    """Bars by symbol and tumbling window, labelled by their end; late prints up to the delay are counted."""
    at = F.struct("ts_ms", *order)
    timed = prints if "event_time" in prints.columns else with_event_time(prints, delay)
    out = timed.groupBy("symbol", F.window("event_time", width).alias("w")).agg(
        F.min_by("price_u", at).alias("open_u"), F.max("price_u").alias("high_u"), F.min("price_u").alias("low_u"), F.max_by("price_u", at).alias("close_u"), F.sum("qty_u").alias("vol_qu"), F.count("*").alias("n")
    )
    return out.select("symbol", F.unix_millis(F.col("w.end")).alias("ts_ms"), "open_u", "high_u", "low_u", "close_u", "vol_qu", "n")


def tape_gaps(polls: DataFrame, beyond_ms: int) -> DataFrame:
    """(symbol, gap_lo_ms, gap_hi_ms) where a poll's prints begin more than beyond_ms after the last one seen before.

    State is the newest print of each symbol. Prints of one batch are put in order first; older ones don't move it."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, rows = (state.get[0] if state.exists else None), []
        for t in sorted(t for pdf in batches for t in pdf["ts_ms"].tolist()):
            if last is not None and t - last > beyond_ms:
                rows.append((key[0], last, t))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(rows, columns=["symbol", "gap_lo_ms", "gap_hi_ms"])

    return polls.select("symbol", "ts_ms").groupBy("symbol").applyInPandasWithState(update, "symbol long, gap_lo_ms long, gap_hi_ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def tier_changes(scores: DataFrame, up: tuple[float, ...] = (0.3, 0.6), down: float = 0.1, dwell_ms: int = 600_000) -> DataFrame:
    """(symbol, ts_ms, from_tier, to_tier): a symbol rises to the tier whose bound its score reaches, and falls one tier
    when the score is `down` below the bound of its own, but not before dwell_ms have passed since its last change."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tier, since, rows = *(state.get if state.exists else (1, None)), []
        for t, score in sorted((t, s) for pdf in batches for t, s in zip(pdf["ts_ms"].tolist(), pdf["score"].tolist(), strict=True)):
            wanted = 1 + sum(score >= bound for bound in up)
            settled = since is None or t - since >= dwell_ms
            new = wanted if wanted > tier else tier - 1 if tier > 1 and score < up[tier - 2] - down and settled else tier
            if new != tier:
                rows.append((key[0], t, tier, new))
                tier, since = new, t
        state.update((tier, since))
        yield pd.DataFrame(rows, columns=["symbol", "ts_ms", "from_tier", "to_tier"])

    return scores.select("symbol", "ts_ms", "score").groupBy("symbol").applyInPandasWithState(
        update, "symbol long, ts_ms long, from_tier int, to_tier int", "tier int, since long", "append", GroupStateTimeout.NoTimeout
    )


def upsert_sink(path_of: Callable[[int], str], keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch's last row of every key to the path of its epoch; the same epoch
    written again gives the same files."""
    from tidemark.sources.store import last_wins

    def write(batch: DataFrame, epoch: int) -> None:
        last_wins(batch, keys, order).write.mode("overwrite").parquet(path_of(epoch))

    return write
