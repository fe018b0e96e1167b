"""Collector logs as tables: tape gaps, telemetry with its peaks and configurations, restarts and transitions.

Lines are read by Spark's text source, which cuts plain files into ranges and reads compressed ones whole; every operator is
column expressions over lines, so filters on time drop lines before anything is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAMP = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d),(\d{3}) +(\w+) (.*)$"
#: A gap in a symbol's prints: the newest print of the poll before, the oldest of this one, and how many this one had.
TAPE_GAP = r"^tape gap (\S+): prev_max=(\d+) < this_min=(\d+) \(n=(\d+)\)"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ts_ms, level, message) of stamped lines under a path, live and rotated, plain and compressed; stamps are UTC.

    Lines without a stamp, of stack traces for example, have nulls and the whole line as message."""
    raw = spark.read.text(path, recursiveFileLookup=True)
    part = lambda k: F.regexp_extract("value", STAMP, k)
    stamped = F.col("value").rlike(STAMP)
    seconds = F.unix_seconds(F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")))
    return raw.select(
        F.when(stamped, seconds * 1000 + part(2).cast("long")).alias("ts_ms"), F.when(stamped, part(3)).alias("level"), F.when(stamped, part(4)).otherwise(F.col("value")).alias("message")
    )


def within(lines: DataFrame, low_ms: int | None, high_ms: int | None) -> DataFrame:
    """Stamped lines of a closed window of time; None leaves a side open."""
    out = lines.where("ts_ms is not null")
    out = out if low_ms is None else out.where(F.col("ts_ms") >= low_ms)
    return out if high_ms is None else out.where(F.col("ts_ms") <= high_ms)


def tape_gaps(lines: DataFrame, reentry_ms: int = 3_600_000, cap: int = 50) -> DataFrame:
    """(ts_ms, symbol, prev_ms, cur_ms, n, hole_s, reentry, at_cap): the gaps that a collector warned of.

    A hole longer than reentry_ms is a symbol that came back to the tape rather than lost prints. at_cap: the poll was as
    full as polls can be, so prints between were cut off."""
    part = lambda k: F.regexp_extract("message", TAPE_GAP, k)
    found = lines.where((F.col("level") == "WARNING") & F.col("message").rlike(TAPE_GAP))
    out = found.select("ts_ms", part(1).alias("symbol"), part(2).cast("long").alias("prev_ms"), part(3).cast("long").alias("cur_ms"), part(4).cast("long").alias("n"))
    hole = F.col("cur_ms") - F.col("prev_ms")
    return out.select("*", (hole / 1000).alias("hole_s"), (hole > reentry_ms).alias("reentry"), (F.col("n") >= cap).alias("at_cap"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """One row: warnings, those that were re-entries, holes within sessions, of these at the cap, and quantiles of both.

    Quantiles are exact over the holes' distinct lengths, which are whole milliseconds up to reentry_ms."""
    hole = F.when(~F.col("reentry"), F.col("hole_s"))
    capped = F.when(~F.col("reentry") & F.col("at_cap"), F.col("hole_s"))
    quantiles = [F.percentile(v, q).alias(f"{name}_p{round(100 * q)}") for name, v in (("hole_s", hole), ("capped_s", capped)) for q in (0.5, 0.9)]
    out = gaps.agg(F.count("*").alias("n_lines"), F.count_if("reentry").alias("n_reentry"), F.count(hole).alias("n_holes"), F.count(capped).alias("n_capped"), *quantiles)
    return out.withColumn("capped_share", F.try_divide("n_capped", "n_holes"))


def worst_symbols(gaps: DataFrame, top: int = 10) -> DataFrame:
    """(symbol, n_gaps, longest_s): the symbols with most holes within sessions, ties to the smaller name."""
    n = gaps.where("not reentry").groupBy("symbol").agg(F.count("*").alias("n_gaps"), F.max("hole_s").alias("longest_s"))
    return n.orderBy(F.desc("n_gaps"), "symbol").limit(top)


def telemetry(lines: DataFrame) -> DataFrame:
    """(ts_ms, fields: map): the key=value pairs of telemetry lines; of a key that comes twice the last counts."""
    pairs = F.regexp_extract_all("message", F.lit(r"(\w+)=(\S+)"), F.lit(0))
    last = F.transform(F.map_values(F.map_filter(F.map_from_arrays(F.sequence(F.lit(1), F.size(pairs)), pairs), lambda k, v: ~F.exists(F.slice(pairs, k + 1, F.size(pairs)), lambda w: F.split(w, "=", 2)[0] == F.split(v, "=", 2)[0]))), lambda p: F.struct(F.split(p, "=", 2)[0].alias("k"), F.split(p, "=", 2)[1].alias("v")))
    found = lines.where(F.col("message").startswith("telemetry ") & F.col("message").rlike(r"\w=\S"))
    return found.select("ts_ms", F.map_from_entries(last).alias("fields"))


def peak(field: str) -> Column:
    return F.try_to_number(F.col("fields")[field], F.lit("999999999")).cast("long")


def windowed_peaks(told: DataFrame, width_ms: int, peaks: tuple[str, ...], signature: str = "config_sig") -> DataFrame:
    """(start_ms, n, signatures, <peak>_max, <peak>_p95): by tumbling window, the set of configurations in force, sorted, and each
    peak's largest value and 95th percentile by nearest rank."""
    start = (F.floor(F.col("ts_ms") / width_ms) * width_ms).cast("long")
    values = told.select(start.alias("start_ms"), F.col("fields")[signature].alias("signature"), *[peak(p).alias(p) for p in peaks])
    counted = values.groupBy("start_ms").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("signature")).alias("signatures"), *[F.max(p).alias(f"{p}_max") for p in peaks])
    for p in peaks:  # values are counted before they are put in order
        n = values.where(F.col(p).isNotNull()).groupBy("start_ms", p).agg(F.count("*").alias("c"))
        run = F.sum("c").over(Window.partitionBy("start_ms").orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
        whole = F.sum("c").over(Window.partitionBy("start_ms"))
        ranked = n.select("start_ms", p, run.alias("run"), F.ceil(whole * 95 / 100).alias("wanted")).where("run >= wanted")
        counted = counted.join(ranked.groupBy("start_ms").agg(F.min(p).alias(f"{p}_p95")), "start_ms", "left")
    return counted


def restarts(lines: DataFrame, pattern: str, day_ms: int = 86_400_000) -> DataFrame:
    """(ts_ms, last_ms, silent_ms): restarts, the last line before each, and how long the log was silent between.

    Lines are put in order within days; a day's first line follows the last one of the latest day before."""
    stamped = lines.where("ts_ms is not null").select("ts_ms", F.col("message").rlike(pattern).alias("restart"), F.floor(F.col("ts_ms") / day_ms).alias("d"))
    at = stamped.groupBy("d", "ts_ms").agg(F.max("restart").alias("restart"))
    inside = at.withColumn("last_ms", F.lag("ts_ms").over(Window.partitionBy("d").orderBy("ts_ms")))
    days = at.groupBy("d").agg(F.max("ts_ms").alias("end")).select("d", F.lag("end").over(Window.orderBy("d")).alias("before"))
    out = inside.where("restart").join(days, "d").select("ts_ms", F.coalesce("last_ms", "before").alias("last_ms"))
    return out.withColumn("silent_ms", F.col("ts_ms") - F.col("last_ms"))


def transitions(lines: DataFrame) -> DataFrame:
    """(ts_ms, from_session, to_session) of lines that tell of a change of session."""
    pattern = r"^session (\w+) -> (\w+)$"
    found = lines.where(F.col("message").rlike(pattern))
    return found.select("ts_ms", F.regexp_extract("message", pattern, 1).alias("from_session"), F.regexp_extract("message", pattern, 2).alias("to_session"))
