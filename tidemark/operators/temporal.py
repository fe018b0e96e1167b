"""Time joins and windows: as-of, range counts, overlaps, islands, dense grids, ledgers.

All are one shuffle by key and a sort, or an equi-join on key and time bucket; none compares all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import BUCKETS, running_sums

#: Width of the slices of time into which a key is cut, so that one with very many rows is sorted by many tasks.
SLICE_MS = 7 * 86_400_000


def asof_join(
    left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], tolerance_ms: int | None = None, forward: bool = False, tie: str | None = None, strict: bool = False, slice_ms: int | None = SLICE_MS
) -> DataFrame:
    """left with the values of the last row of right at or before its time (forward: the first at or after), per key.

    Both sides are put together and sorted once, and the latest right row is carried along. With slice_ms, keys are cut into
    slices of time, so that a key with very many rows is sorted by many tasks: each slice carries its own rows along, and
    takes what was last before it from the slices' last rows, which are few. Of right rows of one time
    the largest `tie` counts (forward: the smallest). strict: the time itself doesn't match. Adds right_<time>; beyond
    the tolerance all added columns are null. Null keys or times match nothing."""
    carried = list(dict.fromkeys([time, *([tie] if tie else []), *values]))
    rows = left.select(F.struct(*left.columns).alias("__left"), F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(None).cast(right.select(F.struct(*carried).alias("x")).schema["x"].dataType).alias("__right"))
    found = right.select(F.lit(None).cast(rows.schema["__left"].dataType).alias("__left"), F.col(key).alias("__k"), F.col(time).alias("__t"), F.struct(*carried).alias("__right"))
    both = rows.unionByName(found)
    # of one time, right rows are passed first if they may match, else last
    side = F.when(F.col("__left").isNull(), int(strict)).otherwise(int(not strict))
    ties = F.col(f"__right.{tie}") if tie else F.lit(0)
    order = [F.desc("__t"), side, ties.desc()] if forward else [F.asc("__t"), side, ties.asc()]
    if slice_ms is None:
        frame = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("__found", F.last("__right", ignorenulls=True).over(frame)).where(F.col("__left").isNotNull())
    else:
        both = both.withColumn("__s", F.floor(F.col("__t") / slice_ms))
        frame = Window.partitionBy("__k", "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        # a slice's last row in the order: the latest time, and its largest tie; forward: the earliest and smallest
        place = F.struct("__t", ties.alias("__tie"))
        seen = found.withColumn("__s", F.floor(F.col("__t") / slice_ms)).groupBy("__k", "__s").agg((F.min_by if forward else F.max_by)("__right", place).alias("__last"))
        at = both.where(F.col("__left").isNotNull()).select("__k", "__s").distinct().join(seen, ["__k", "__s"], "full")
        before = Window.partitionBy("__k").orderBy(F.desc("__s") if forward else F.asc("__s")).rowsBetween(Window.unboundedPreceding, -1)
        carried = at.select(F.col("__k").alias("__ck"), F.col("__s").alias("__cs"), F.last("__last", ignorenulls=True).over(before).alias("__carried"))
        inside = both.withColumn("__found", F.last("__right", ignorenulls=True).over(frame)).where(F.col("__left").isNotNull())
        out = inside.join(carried, (F.col("__k") == F.col("__ck")) & (F.col("__s") == F.col("__cs")), "left").withColumn("__found", F.coalesce("__found", "__carried"))
    gap = F.abs(F.col("__t") - F.col(f"__found.{time}"))
    near = F.col("__k").isNotNull() & F.col("__t").isNotNull() & (F.lit(True) if tolerance_ms is None else gap <= tolerance_ms)
    picked = [F.when(near, F.col(f"__found.{c}")).alias(f"right_{time}" if c == time else c) for c in [time, *values]]
    return out.select("__left.*", *picked)


def range_pairs(left: DataFrame, right: DataFrame, key: str, time: str, low_ms: int, high_ms: int, right_prefix: str = "r_") -> DataFrame:
    """Pairs of one key with low < right time - left time <= high, by an equi-join on key and time bucket.

    Buckets are as wide as the range, so a left row meets two or three of them. Right columns get the prefix."""
    width = max(1, high_ms - low_ms)
    r = right.select(*[F.col(c).alias(right_prefix + c) for c in right.columns]).withColumn("__b", F.floor(F.col(right_prefix + time) / width))
    first, last = F.floor((F.col(time) + low_ms) / width), F.floor((F.col(time) + high_ms) / width)
    spread = left.withColumn("__b", F.explode(F.sequence(first, last)))
    gap = F.col(right_prefix + time) - F.col(time)
    return spread.join(r, (F.col(key) == F.col(right_prefix + key)) & (spread["__b"] == r["__b"])).where((gap > low_ms) & (gap <= high_ms)).drop("__b", right_prefix + key)


def _carried(rows: DataFrame, values: dict[str, Column], slice_ms: int) -> DataFrame:
    """rows (__k, __t, ...) with, for each named value, its sum over all rows of the key up to and at the time.

    Within slices it runs in order of time; what came before a slice is added from the slices' totals, one row each."""
    cut = rows.withColumn("__s", F.floor(F.col("__t") / slice_ms)).withColumns({f"__v_{n}": v for n, v in values.items()})
    run = Window.partitionBy("__k", "__s").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({f"__in_{n}": F.sum(f"__v_{n}").over(run) for n in values})
    before = Window.partitionBy("__k").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("__k", "__s").agg(*[F.sum(f"__v_{n}").alias(f"__total_{n}") for n in values])
    slices = totals.select(F.col("__k").alias("__bk"), F.col("__s").alias("__bs"), *[F.sum(f"__total_{n}").over(before).alias(f"__before_{n}") for n in values])
    both = inside.join(slices, (F.col("__k") == F.col("__bk")) & (F.col("__s") == F.col("__bs")), "left")
    out = both.withColumns({n: F.coalesce(F.col(f"__in_{n}"), F.lit(0)) + F.coalesce(F.col(f"__before_{n}"), F.lit(0)) for n in values})
    return out.drop("__s", "__bk", "__bs", *[f"__{x}_{n}" for n in values for x in ("v", "in", "before")])


def mark_counts(events: DataFrame, key: str, time: str, marks: dict[str, DataFrame], asked: dict[str, list[tuple[int, str, int]]], slice_ms: int = SLICE_MS) -> DataFrame:
    """events with, for each asked name, the sum over its (sign, kind, offset) of sign times how many marks of that kind the
    key has at or before time + offset.

    marks: by kind, rows of the same key and time columns. All kinds are counted as running numbers in one pass, so nothing
    is paired. Events are told apart by their values; those that are equal count once and are repeated at the end. A null key
    or time has no marks."""
    lookups = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("sign"), F.lit(k).alias("kind"), F.lit(o).cast("long").alias("offset")) for n, terms in asked.items() for s, k, o in terms])
    distinct = events.groupBy(F.struct(*events.columns).alias("__e")).agg(F.count(F.lit(1)).alias("__copies"))
    rows = distinct.select("__e", "__copies", F.col(f"__e.{key}").alias("__k"), F.col(f"__e.{time}").alias("__base"), F.explode(lookups).alias("__m")).select(
        "__k", (F.col("__base") + F.col("__m.offset")).alias("__t"), F.lit(None).cast("string").alias("__mark"), "__e", "__copies", F.col("__m.name").alias("__name"), F.col("__m.sign").alias("__sign"), F.col("__m.kind").alias("__kind")
    )
    for kind, df in marks.items():
        some = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(kind).alias("__mark"))
        rows = rows.unionByName(some, allowMissingColumns=True)
    running = _carried(rows, {f"__n_{kind}": (F.col("__mark") == kind).cast("int") for kind in marks}, slice_ms).where("__copies is not null")
    seen = F.coalesce(*[F.when(F.col("__kind") == kind, F.col(f"__n_{kind}")) for kind in marks])
    counts = [F.coalesce(F.sum(F.when(F.col("__name") == n, F.col("__sign") * seen)), F.lit(0)).alias(n) for n in asked]
    per_row = running.groupBy("__e").agg(F.max("__copies").alias("__copies"), *counts)
    return per_row.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select("__e.*", *asked)


def window_counts(events: DataFrame, prints: DataFrame, key: str, time: str, windows: dict[str, tuple[int, int]], slice_ms: int = SLICE_MS) -> DataFrame:
    """events with, for each named window (low, high], how many prints of the key fall into (time + low, time + high]: the
    difference of the running numbers of prints at the window's ends (see mark_counts)."""
    return mark_counts(events, key, time, {"print": prints}, {n: [(-1, "print", low), (1, "print", high)] for n, (low, high) in windows.items()}, slice_ms)


def overlap_terms(span_ms: int, kind: str = "") -> list[tuple[int, str, int]]:
    """What mark_counts is asked for how many closed intervals meet [time, time + span]: as many as begin by its end, less
    those that ended before it. Their starts and ends are marks of the kinds low and high, after `kind`."""
    return [(1, f"{kind}low", span_ms), (-1, f"{kind}high", -1)]


def interval_marks(intervals: DataFrame, time: str, low: str, high: str, kind: str = "") -> dict[str, DataFrame]:
    """The starts and ends of intervals that don't end before they begin, as marks for overlap_terms."""
    fit = intervals.where(F.col(low) <= F.col(high))
    return {f"{kind}{name}": fit.withColumn(time, F.col(c)) for name, c in (("low", low), ("high", high))}


def overlaps(events: DataFrame, intervals: DataFrame, key: str, time: str, span_ms: int, low: str, high: str, name: str = "overlaps", slice_ms: int = SLICE_MS) -> DataFrame:
    """events with whether [time, time + span] meets a closed interval [low, high] of its key."""
    out = mark_counts(events, key, time, interval_marks(intervals, time, low, high), {name: overlap_terms(span_ms)}, slice_ms)
    return out.withColumn(name, F.col(name) > 0)


def islands(df: DataFrame, key: str, time: str, gap_ms: int, order: list[str] | None = None, name: str = "island") -> DataFrame:
    """df with the number, from 0, of its run of rows that follow each other within gap_ms, per key."""
    w = Window.partitionBy(key).orderBy(time, *(order or []))
    new = (F.col(time) - F.lag(time).over(w) > gap_ms).cast("int")
    return df.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def dense_grid(bars: DataFrame, key: str, time: str, step_ms: int, zeros: list[str]) -> DataFrame:
    """Bars at every step between a key's first and last, with `zeros` 0 where there was none; other columns null."""
    span = bars.groupBy(key).agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    grid = span.select(key, F.explode(F.sequence(F.col("__a"), F.col("__b"), F.lit(step_ms).cast("long"))).alias(time))
    return grid.join(bars, [key, time], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})


def validity(ledger: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """A ledger of changes with valid_from and valid_to (null: still valid); of changes at one time the last counts."""
    last = Window.partitionBy(key, time).orderBy(*[F.desc(c) for c in order])
    kept = ledger.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    w = Window.partitionBy(key).orderBy(time)
    return kept.withColumn("valid_from", F.col(time)).withColumn("valid_to", F.lead(time).over(w))


def population(changes: DataFrame, time: str, delta: str, start_ms: int, end_ms: int) -> DataFrame:
    """Time-weighted mean, least and largest size of a set within [start, end), from signed changes.

    Changes are summed by time, put in order within stretches of the window, and the stretches' sums carried on."""
    at = F.greatest(F.col(time), F.lit(start_ms))
    steps = changes.where(F.col(time) < end_ms).groupBy(at.alias("t")).agg(F.sum(delta).alias("d"))
    steps = steps.union(steps.sparkSession.range(1).select(F.lit(start_ms).cast("long"), F.lit(0).cast("long"))).groupBy("t").agg(F.sum("d").alias("d"))
    bucket = F.floor((F.col("t") - start_ms) * BUCKETS / (end_ms - start_ms))
    sized = running_sums(steps, "t", bucket, {"n": "d"}, following="__to").withColumn("dt", F.coalesce("__to", F.lit(end_ms)) - F.col("t"))
    return sized.where("dt > 0").agg((F.sum(F.col("n") * F.col("dt")) / F.sum("dt")).alias("mean_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))


def trailing(key: str, time: str, span_ms: int, open_left: bool = False) -> Window:
    """The frame [time - span, time] of a key; open_left: (time - span, time]."""
    return Window.partitionBy(key).orderBy(time).rangeBetween(-(span_ms - 1 if open_left else span_ms), 0)


def forward(key: str, time: str, span_ms: int) -> Window:
    """The frame (time, time + span] of a key."""
    return Window.partitionBy(key).orderBy(time).rangeBetween(1, span_ms)


def first_hit(pred: Column, time: str) -> Column:
    return F.min(F.when(pred, F.col(time)))
