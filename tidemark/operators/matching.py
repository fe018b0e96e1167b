"""Controls that resemble events in two measures at once: counts by rung, draws for many seeds in one pass, nearest ones used once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rounds import settled
from tidemark.operators.temporal import SLICE_MS, mark_counts

#: Modulus of the hashes that order a pool: a prime below 2 ** 31, so that products fit 64 bits.
PRIME = (1 << 31) - 1


def _within(a: str, b: str, factor: float) -> Column:
    """Whether two positive numbers are within a factor of each other."""
    return F.greatest(a, b).cast("double") <= F.least(a, b).cast("double") * factor


def near_pairs(events: DataFrame, bars: DataFrame, x: str, z: str, x_factor: float, z_factor: float, gap_ms: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, symbol, control_ms, x_ratio, distance, carry) of events (event_id, symbol, ts_ms, x, z) and bars (symbol, ts_ms, x, z)
    of the symbol that are within the factors in both measures and more than gap_ms away.

    Both measures' logarithms are cut into a grid as wide as the factors, so an event meets the bars of nine cells only.
    carry: columns of the bars that their pairs keep. distance: of the logarithms, each in units of its factor. Measures that aren't positive match nothing."""
    widths = {x: math.log(x_factor) * (1 + 1e-9), z: math.log(z_factor) * (1 + 1e-9)}  # rounding mustn't part cells of a pair just at the factor
    cell = lambda c: F.floor(F.log(c) / widths[c])
    positive = lambda d: d.where((F.col(x) > 0) & (F.col(z) > 0))
    pool = positive(bars).select("symbol", F.col("ts_ms").alias("control_ms"), F.col(x).alias("__x"), F.col(z).alias("__z"), cell(x).alias("__cx"), cell(z).alias("__cz"), *carry)
    asked = positive(events).select("event_id", "symbol", "ts_ms", x, z, F.explode(F.sequence(cell(x) - 1, cell(x) + 1)).alias("__cx"), cell(z).alias("__c"))
    asked = asked.withColumn("__cz", F.explode(F.sequence(F.col("__c") - 1, F.col("__c") + 1)))
    pairs = asked.join(pool, ["symbol", "__cx", "__cz"]).where((F.abs(F.col("control_ms") - F.col("ts_ms")) > gap_ms) & _within(x, "__x", x_factor) & _within(z, "__z", z_factor))
    part = lambda c, d, f: F.abs(F.log(F.col(c) / F.col(d))) / math.log(f)
    return pairs.select("event_id", "symbol", "control_ms", (F.greatest(x, "__x") / F.least(x, "__x")).alias("x_ratio"), F.hypot(part(x, "__x", x_factor), part(z, "__z", z_factor)).alias("distance"), *carry)


def rungs(events: DataFrame, bars: DataFrame, x: str, z: str, x_factor: float, z_factor: float, gap_ms: int) -> DataFrame:
    """(event_id, n_bars, n_gap, n_key, n_x, n_both): how many bars of an event's symbol are left by each condition in turn:
    all; more than gap_ms away; with positive measures; within the factor in x; and in z too.

    The first three are counts of marks, which pair nothing; the others count within grid cells before they are shuffled."""
    usable = bars.where((F.col(x) > 0) & (F.col(z) > 0))
    far = [(1, "bar", gap_ms), (-1, "bar", -gap_ms - 1)]
    near = mark_counts(events.select("event_id", "symbol", "ts_ms"), "symbol", "ts_ms", {"bar": bars, "key": usable}, {"c_bar": far, "c_key": [(s, "key", o) for s, _, o in far]}, SLICE_MS)
    whole = bars.groupBy("symbol").agg(F.count("*").alias("t_bar"), F.count_if((F.col(x) > 0) & (F.col(z) > 0)).alias("t_key"))
    counts = near.join(whole, "symbol", "left").select(
        "event_id", F.coalesce("t_bar", F.lit(0)).alias("n_bars"), F.coalesce(F.col("t_bar") - F.col("c_bar"), F.lit(0)).alias("n_gap"), F.coalesce(F.col("t_key") - F.col("c_key"), F.lit(0)).alias("n_key")
    )
    width = math.log(x_factor) * (1 + 1e-9)
    cell = lambda c: F.floor(F.log(c) / width)
    pool = usable.select("symbol", F.col("ts_ms").alias("control_ms"), F.col(x).alias("__x"), F.col(z).alias("__z"), cell(x).alias("__cx"))
    asked = events.where((F.col(x) > 0) & (F.col(z) > 0)).select("event_id", "symbol", "ts_ms", x, z, F.explode(F.sequence(cell(x) - 1, cell(x) + 1)).alias("__cx"))
    inside = asked.join(pool, ["symbol", "__cx"]).where((F.abs(F.col("control_ms") - F.col("ts_ms")) > gap_ms) & _within(x, "__x", x_factor))
    banded = inside.groupBy("event_id").agg(F.count("*").alias("n_x"), F.count_if(_within(z, "__z", z_factor)).alias("n_both"))
    return counts.join(banded, "event_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_x", "n_both")})


def multiplier(seed: int, draw: int) -> tuple[int, int]:
    """The numbers a, b of the order (a h + b) mod PRIME in which a draw of a seed looks at a pool."""
    digest = hashlib.md5(f"{seed}-{draw}".encode()).digest()
    return 1 + int.from_bytes(digest[:8], "big") % (PRIME - 1), int.from_bytes(digest[8:], "big") % PRIME


def pool_hash(*key: str) -> Column:
    """A control's number below PRIME, from its key."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in key])), 1, 12), 16, 10).cast("long") % PRIME


def draw_pools(pairs: DataFrame, by: list[str], seeds: int, draws: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_pool, drawn): for each of `seeds` seeds, `draws` controls drawn with replacement from each pool of pairs (by,
    control_ms, carry), as an array of (seed, draw, control_ms, carry).

    A draw takes the control whose hash comes first in an order of its own, so all draws of all seeds are minima of one
    aggregate over the pool. Ties go to the earlier bar. Where pairs are dealt by one of the keys already, the aggregate
    shuffles nothing."""
    hashed = pairs.withColumn("__h", pool_hash(*by, "control_ms"))
    numbers = [(s, d, *multiplier(s, d)) for s in range(seeds) for d in range(1, draws + 1)]
    first = [F.min(F.struct(((F.col("__h") * a + b) % PRIME).alias("h"), "control_ms", *carry)).alias(f"d{s}_{d}") for s, d, a, b in numbers]
    pools = hashed.groupBy(*by).agg(F.count("*").alias("n_pool"), *first)
    taken = lambda s, d: [F.col(f"d{s}_{d}.{c}").alias(c) for c in ("control_ms", *carry)]
    each = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(d).alias("draw"), *taken(s, d)) for s, d, _, _ in numbers])
    return pools.select(*by, "n_pool", each.alias("drawn"))


def draw_many(pairs: DataFrame, by: list[str], seeds: int, draws: int) -> DataFrame:
    """(by, n_pool, seed, draw, control_ms): the draws of draw_pools, a row each."""
    return draw_pools(pairs, by, seeds, draws).select(*by, "n_pool", F.inline("drawn"))


def nearest_once(pairs: DataFrame, event: str = "event_id", control: tuple[str, ...] = ("symbol", "control_ms"), without: Callable[[DataFrame], DataFrame] | None = None, anew: int = 3) -> DataFrame:
    """(event, control, distance, round): events matched to their nearest controls, each control used once.

    The result is that of taking pairs in order of distance (ties by event, then control) whenever neither side is taken. All
    pairs that are each other's first choice are taken at once, and the rest is looked at again, until none is left; a round
    takes at least the nearest pair of every symbol, and usually most. Pairs are told to the matched by joins.
    without: makes the pairs of the events and controls that matched rows (event, control) leave. It follows the first `anew`
    rounds, so that most pairs are never written or shuffled, only their minima; otherwise all of them are written once."""
    names, out, k = [event, *control, "distance"], None, 0
    left = pairs.select(names) if without else settled(pairs.select(names))
    rank = F.struct("distance", event, *control)
    while True:
        k += 1
        by_event = left.groupBy(event).agg(F.min(rank).alias("best")).select("best.*")
        by_control = left.groupBy(*control).agg(F.min(rank).alias("best")).select("best.*")
        taken = settled(by_event.join(by_control, names))
        if taken.isEmpty():  # whatever pairs there are have a nearest
            break
        part = taken.withColumn("round", F.lit(k))
        out = part if out is None else out.unionByName(part)
        if without and k <= anew:
            left = without(out).select(names)
            left = settled(left) if k == anew else left
        else:
            left = settled(left.join(taken.select(event), event, "left_anti").join(taken.select(*control), list(control), "left_anti"))
    return pairs.select(names).limit(0).withColumn("round", F.lit(0)) if out is None else out


def nearest_bars_once(events: DataFrame, bars: DataFrame, x: str, z: str, x_factor: float, z_factor: float, gap_ms: int) -> DataFrame:
    """nearest_once of the near_pairs of events and bars, which are paired anew when many of them are matched."""
    events, bars = settled(events.select("event_id", "symbol", "ts_ms", x, z)), settled(bars.select("symbol", "ts_ms", x, z))
    paired = lambda e, b: near_pairs(e, b, x, z, x_factor, z_factor, gap_ms)

    def without(taken: DataFrame) -> DataFrame:
        used = taken.select("symbol", F.col("control_ms").alias("ts_ms"))
        return paired(events.join(taken.select("event_id"), "event_id", "left_anti"), bars.join(used, ["symbol", "ts_ms"], "left_anti"))

    return nearest_once(paired(events, bars), without=without)
