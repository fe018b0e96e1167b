"""A multi-label inventory of ranking events: what kinds each is, what else overlaps it, and how its tape was covered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import sessions as S
from tidemark.operators.rankings import numbered
from tidemark.operators.temporal import asof_join, interval_marks, mark_counts, overlap_terms


@dataclass(frozen=True)
class Cells:
    """The parameters of each kind: sizes of the top, least improvements, ranks that jumps start from, least lengths of stay."""

    tops: tuple[int, ...] = (10, 20)
    jumps: tuple[int, ...] = (10, 30)
    jump_from: tuple[tuple[int, int], ...] = ((11, 30), (31, 100))
    stays: tuple[int, ...] = (2, 3)


def _labels(cells: Cells) -> Column:
    """Structs (kind, cell) of all that a row of a ranking is, from its neighbours in the symbol's own rows."""
    rank, idx = F.col("rank"), F.col("idx")
    follows = F.coalesce(F.col("prev_idx") == idx - 1, F.lit(False))
    better = F.when(follows, F.col("prev_rank") - rank)
    made: list[tuple[str, str, Column]] = []
    for n in cells.tops:
        entered = (idx > 1) & (rank <= n) & ~(follows & (F.col("prev_rank") <= n))
        made.append(("new_entry", f"top{n}", entered))
        stayed = entered
        for k in range(1, max(cells.stays)):
            stayed = stayed & (F.col("next")[k - 1]["idx"] == idx + k) & (F.col("next")[k - 1]["rank"] <= n)
            if k + 1 in cells.stays:
                made.append(("dwell_start", f"top{n}_for{k + 1}", stayed))
    for by in cells.jumps:
        made.append(("rank_jump", f"by{by}", better >= by))
        made += [("rank_jump", f"by{by}_from{a}_{b}", (better >= by) & F.col("prev_rank").between(a, b)) for a, b in cells.jump_from]
    return F.filter(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(c).alias("cell"))) for k, c, p in made]), lambda x: x.isNotNull())


def ranking_events(rankings: DataFrame, cells: Cells) -> DataFrame:
    """(ranking_type, snap_ms, symbol, rank, prev_gap_ms, labels): one row for each ranked row that is an event of any kind.

    New entries, jumps between consecutive snapshots, and entries that stay for a number of snapshots; labels is the set of
    all (kind, cell) that fit. One sorted pass over each list's symbols finds all of them: a stay looks ahead as many rows
    as it must last. Stays that the end of the data cuts short aren't known to last and have no label. prev_gap_ms is the
    time since the snapshot before; the first snapshot has no events."""
    w = Window.partitionBy("ranking_type", "symbol").orderBy("idx")
    ranks = numbered(rankings)
    snaps = ranks.select("ranking_type", "snap_ms").distinct()
    gaps = snaps.withColumn("prev_gap_ms", F.col("snap_ms") - F.lag("snap_ms").over(Window.partitionBy("ranking_type").orderBy("snap_ms")))
    ahead = [F.struct(F.lead("idx", k).over(w).alias("idx"), F.lead("rank", k).over(w).alias("rank")) for k in range(1, max(cells.stays))]
    seen = ranks.withColumns({"prev_idx": F.lag("idx").over(w), "prev_rank": F.lag("rank").over(w), "next": F.array(*ahead)})
    found = seen.withColumn("labels", _labels(cells)).where(F.size("labels") > 0)
    return found.join(gaps, ["ranking_type", "snap_ms"]).select("ranking_type", "snap_ms", "symbol", "rank", "prev_gap_ms", "labels")


def with_overlapping(events: DataFrame, span_ms: int) -> DataFrame:
    """events with `overlapping`, the sorted set of kinds of all of the symbol's events, in any list, whose windows
    [snap, snap + span] meet its own, and n_overlapping, how many other events these are."""
    w = Window.partitionBy("symbol").orderBy("snap_ms").rangeBetween(-span_ms, span_ms)
    kinds = F.transform("labels", lambda x: x["kind"])
    return events.withColumn("overlapping", F.array_sort(F.array_distinct(F.flatten(F.collect_set(kinds).over(w))))).withColumn("n_overlapping", F.count("*").over(w) - 1)


def tape_around(asked: DataFrame, tape: DataFrame, gaps: DataFrame, before_ms: int, windows: dict[str, int]) -> DataFrame:
    """asked (symbol, snap_ms) with what the tape holds around each instant, and whether it could hold it.

    n_before: prints in [snap - before, snap); for each named window n_<name>: prints in (snap, snap + ms], and gap_<name>:
    whether it meets a gap of the symbol's tape (gaps: symbol, lo_ms, hi_ms). no_tape: no print of the symbol on the date."""
    timed = {"print": tape.withColumnRenamed("ts_ms", "snap_ms")} | interval_marks(gaps, "snap_ms", "lo_ms", "hi_ms")
    wanted = {"n_before": [(-1, "print", -before_ms - 1), (1, "print", -1)]}
    wanted |= {f"n_{n}": [(-1, "print", 0), (1, "print", ms)] for n, ms in windows.items()}
    wanted |= {f"gap_{n}": overlap_terms(ms) for n, ms in windows.items()}
    out = mark_counts(asked, "symbol", "snap_ms", timed, wanted)
    traded = tape.select("symbol", S.session_date(F.col("ts_ms")).alias("session"), F.lit(False).alias("no_tape")).distinct()
    out = out.withColumn("session", S.session_date(F.col("snap_ms"))).join(traded, ["symbol", "session"], "left")
    return out.withColumns({"no_tape": F.coalesce("no_tape", F.lit(True)), **{f"gap_{n}": F.col(f"gap_{n}") > 0 for n in windows}})


def outages_around(snaps: DataFrame, outages: DataFrame, windows: dict[str, int]) -> DataFrame:
    """snaps (snap_ms) with down_<name>: whether (lo_ms, hi_ms) of an outage of the whole collector meets each window."""
    everyone = interval_marks(outages.select(F.lit(0).alias("all"), "lo_ms", "hi_ms"), "snap_ms", "lo_ms", "hi_ms")
    out = mark_counts(snaps.select(F.lit(0).alias("all"), "snap_ms"), "all", "snap_ms", everyone, {f"down_{n}": overlap_terms(ms) for n, ms in windows.items()})
    return out.select("snap_ms", *[(F.col(f"down_{n}") > 0).alias(f"down_{n}") for n in windows])


def inventory(
    rankings: DataFrame, prices: DataFrame, tape: DataFrame, outages: DataFrame, gaps: DataFrame, about: DataFrame, cells: Cells, span_ms: int, before_ms: int, stale_ms: int, windows: dict[str, int]
) -> DataFrame:
    """One row for each ranking event and label, with what overlaps it, its tape and the strata it is counted in.

    See ranking_events, with_overlapping, tape_around and outages_around. band: the session of the instant; price_band: of the
    last price at or before it; market: from about (symbol, market); unknown where there is none. stale_prev: the snapshot
    before is too old to say what changed. zero_before and zero_<name> mark windows without a print. The tape is looked up
    for each ranked symbol and instant once, whatever lists and labels it has."""
    events = with_overlapping(ranking_events(rankings, cells), span_ms)
    asked = rankings.select("symbol", "snap_ms").distinct()
    at = asof_join(asked.withColumn("ts_ms", F.col("snap_ms")), prices, "symbol", "ts_ms", ["price_u"], tie="event_id").drop("ts_ms", "right_ts_ms")
    out = (
        events.join(tape_around(asked, tape, gaps, before_ms, windows), ["symbol", "snap_ms"])
        .join(at, ["symbol", "snap_ms"])
        .join(outages_around(rankings.select("snap_ms").distinct(), outages, windows), "snap_ms")
        .join(about.select("symbol", "market"), "symbol", "left")
    )
    out = out.withColumns(
        {
            "band": S.session_of(F.col("snap_ms")),
            "price_band": S.price_band(F.col("price_u") / 1_000_000),
            "market": F.coalesce("market", F.lit("unknown")),
            "stale_prev": F.col("prev_gap_ms") > stale_ms,
            "zero_before": F.col("n_before") == 0,
            **{f"zero_{n}": F.col(f"n_{n}") == 0 for n in windows},
        }
    )
    return out.withColumn("label", F.explode("labels")).select("*", "label.kind", "label.cell").drop("labels", "label", "price_u")


def cube(rows: DataFrame, windows: dict[str, int]) -> DataFrame:
    """The inventory folded to sums by list, session, band, kind, cell, price band and market: sums of chunks add up."""
    keys = ["ranking_type", "session", "band", "kind", "cell", "price_band", "market"]
    flags = ["no_tape", "stale_prev", "zero_before", *[f"{x}_{n}" for n in windows for x in ("zero", "down", "gap")]]
    counts = ["n_before", *[f"n_{n}" for n in windows]]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{c}" if not c.startswith("n_") else c) for c in flags], *[F.sum(c).alias(f"sum_{c[2:]}") for c in counts])
