"""Session labels of instants and bars, and other bucketings of scalars, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
KST_OFFSET_MS = 9 * 3_600_000
#: Minutes of the KST day at which sessions begin and end (fixed values); regular wraps around midnight.
SESSIONS = {"day": (540, 1020), "pre": (1020, 1350), "regular": (1350, 300), "after": (300, 530)}
#: Upper bounds in US dollars of price bands (fixed values).
PRICE_BANDS = (0.5, 1.0, 2.0, 5.0, 20.0)
PRICE_LABELS = ("$0.10-0.50", "$0.50-1", "$1-2", "$2-5", "$5-20", "$20+")


def bar_start_ms(label: Column, width_ms: int = MINUTE_MS) -> Column:
    """Bars are labelled by their end."""
    return label - width_ms


def kst_minute(ts_ms: Column) -> Column:
    return F.pmod(F.floor((ts_ms + KST_OFFSET_MS) / MINUTE_MS), F.lit(1440)).cast("int")


def session_of(ts_ms: Column) -> Column:
    """The session of an instant: begins are inside, ends are outside; none: closed."""
    m = kst_minute(ts_ms)
    out = None
    for name, (a, b) in SESSIONS.items():
        inside = (m >= a) & (m < b) if a < b else (m >= a) | (m < b)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("closed")


def session_date(ts_ms: Column) -> Column:
    """The cycle's date: it begins at 09:00 KST, which is midnight UTC."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ms / 86_400_000).cast("int"))


def bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    """The number of bounds at or below value; null stays null."""
    return F.when(value.isNotNull(), sum((value >= b).cast("int") for b in bounds))


def price_band(price_usd: Column) -> Column:
    """The label of a price's band; unknown for null, NaN and prices that aren't above zero."""
    out = F.when(price_usd.isNull() | F.isnan(price_usd) | (price_usd <= 0), "unknown")
    for bound, label in zip(PRICE_BANDS, PRICE_LABELS, strict=False):
        out = out.when(price_usd < bound, label)
    return out.otherwise(PRICE_LABELS[-1])


def floor_label(ts_ms: Column, width_ms: int = MINUTE_MS) -> Column:
    """The label of the last bar that has ended."""
    return ts_ms - F.pmod(ts_ms, F.lit(width_ms))


def ramp(value: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high, linear between; null counts as 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))), F.lit(0.0))
