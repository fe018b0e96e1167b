"""Events on daily bars: threshold moves with labels, shapes of outcomes, and greedy impulses."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import ratio
from tidemark.operators.temporal import islands


def daily_events(bars: DataFrame, ret_min: float, horizon: int, time: str = "day") -> DataFrame:
    """Bars whose high is ret_min or more above the close before, with labels over the next `horizon` bars of the symbol.

    ret: the high's move; peak_ret: the highest high, this bar included; ret_close: the last close; drawdown: the lowest
    low of the bars from this one over the peak; outcome: dump (drawdown of 20 % or more), fade (less than half of the
    peak kept at the close), else hold."""
    w = Window.partitionBy("symbol").orderBy(time)
    ahead = w.rowsBetween(0, horizon)
    based = bars.withColumn("prev_close_u", F.lag("close_u").over(w))
    based = based.withColumns({"__peak": F.max("high_u").over(ahead), "__last": F.last("close_u").over(ahead), "__low": F.min("low_u").over(ahead)})
    ret = lambda c: ratio(F.col(c), F.col("prev_close_u")) - 1
    out = based.where((F.col("prev_close_u") > 0) & (F.col("high_u") >= F.col("prev_close_u") * (1 + ret_min))).withColumns({"ret": ret("high_u"), "peak_ret": ret("__peak"), "ret_close": ret("__last"), "drawdown": ratio(F.col("__low"), F.col("__peak")) - 1})
    outcome = F.when(F.col("drawdown") <= -0.2, "dump").when(F.col("ret_close") < 0.5 * F.col("peak_ret"), "fade").otherwise("hold")
    return out.withColumn("outcome", outcome).drop("__peak", "__last", "__low")


def causal_fires(series: DataFrame, rise: float, span_ms: int, cooldown_ms: int) -> DataFrame:
    """Rows (symbol, ts_ms, price_u) at which price / trailing minimum first reaches 1 + rise, and again only after it has
    been below and cooldown_ms have passed since the last fire.

    The rising edges come from windows. An edge that follows the one before it by the cooldown or more always fires, whatever
    came earlier, so edges are cut there; the cooldown is a greedy scan within such stretches of edges alone. Stretches are
    sorted within partitions and streamed through the scan: most hold an edge or two, too few for a call each."""
    w = Window.partitionBy("symbol").orderBy("ts_ms").rangeBetween(-span_ms, 0)
    above = series.withColumn("low_u", F.min("price_u").over(w)).withColumn("__a", (F.col("price_u") >= F.col("low_u") * (1 + rise)).cast("int"))
    edges = above.withColumn("__b", F.lag("__a").over(Window.partitionBy("symbol").orderBy("ts_ms"))).where("__a = 1 and coalesce(__b, 0) = 0")

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = last = None
        for batch in batches:
            keep = []
            for s, i, t in zip(*(batch.column(c).to_pylist() for c in ("symbol", "island", "ts_ms")), strict=True):
                keep.append((s, i) != stretch or None not in (t, last) and t - last >= cooldown_ms)
                stretch, last = (s, i), t if keep[-1] else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    cut = islands(edges.select("symbol", "ts_ms", "price_u", "low_u"), "symbol", "ts_ms", cooldown_ms - 1)
    dealt = cut.repartition("symbol", "island").sortWithinPartitions("symbol", "island", F.col("ts_ms").asc_nulls_last())
    return dealt.mapInArrow(greedy, dealt.schema).drop("island")


def impulses(series: DataFrame, rise: float, span_ms: int, gap_ms: int) -> DataFrame:
    """Greedy upward moves, without overlap, per symbol and run of rows without a gap beyond gap_ms.

    From a running low, a move is found once the price is `rise` above it within span_ms; it goes on while prices don't
    fall; the search resumes behind its peak. (symbol, ordinal, start_ms, detect_ms, peak_ms, start_u, detect_u, peak_u).

    Windows find the rows that lie `rise` above their trailing low; only runs that hold one are scanned, each in one pass
    that keeps the candidates for the low in ascending order."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        ts, px, rows, i, n = pdf["ts_ms"].tolist(), pdf["price_u"].tolist(), [], 0, len(pdf)
        lows: deque[int] = deque()  # prices ascend; the first is the lowest of the last span, the earliest among equals
        while i < n:
            while lows and px[lows[-1]] > px[i]:
                lows.pop()
            lows.append(i)
            while ts[i] - ts[lows[0]] > span_ms:
                lows.popleft()
            low = lows[0]
            if low < i and px[i] >= px[low] * (1 + rise):
                peak = i
                while peak + 1 < n and px[peak + 1] >= px[peak]:
                    peak += 1
                rows.append((ts[low], ts[i], ts[peak], px[low], px[i], px[peak]))
                i = peak
                lows.clear()
            i += 1
        out = pd.DataFrame(rows, columns=["start_ms", "detect_ms", "peak_ms", "start_u", "detect_u", "peak_u"])
        out.insert(0, "symbol", pdf["symbol"].iloc[0])
        return out

    near = F.min("price_u").over(Window.partitionBy("symbol").orderBy("ts_ms").rangeBetween(-span_ms, 0))
    risen = islands(series, "symbol", "ts_ms", gap_ms).withColumn("__up", F.col("price_u") >= near * (1 + rise))
    risen = risen.withColumn("__any", F.max("__up").over(Window.partitionBy("symbol", "island"))).where("__any").select("symbol", "island", "ts_ms", "price_u")
    found = risen.groupBy("symbol", "island").applyInPandas(scan, "symbol long, start_ms long, detect_ms long, peak_ms long, start_u long, detect_u long, peak_u long")
    return found.withColumn("ordinal", F.row_number().over(Window.partitionBy("symbol").orderBy("start_ms")))


def overlapping(events: DataFrame, horizon_ms: int) -> DataFrame:
    """events with whether their window [ts, ts + horizon] meets that of a neighbour of the same symbol."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", "event_id")
    near = lambda x: F.coalesce(F.abs(x - F.col("ts_ms")) <= horizon_ms, F.lit(False))
    return events.withColumn("overlaps", near(F.lag("ts_ms").over(w)) | near(F.lead("ts_ms").over(w)))
