"""The tier machine and seats of bounded pools: one set of rules, run over streams with event-time timers and over tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "symbol long, ts_ms long, from_tier int, to_tier int, reason string, score double"
SEATS = "pool long, ts_ms long, symbol long, event string, score double"


@dataclass(frozen=True)
class TierRules:
    """up and down: by tier from 2 on, the scores that let a symbol into it and below which it may leave it."""

    up: tuple[float, ...] = (0.3, 0.6)
    down: tuple[float, ...] = (0.22, 0.5)
    hold_ms: int = 600_000
    stale_ms: int | None = 3_600_000


class TierState:
    """One symbol: its tier, when that last changed, since when it has been weak, and when it was last heard of."""

    FIELDS = "tier int, changed long, below long, last long, score double"

    def __init__(self, rules: TierRules, tier: int = 1, changed: int | None = None, below: int | None = None, last: int | None = None, score: float | None = None):
        self.rules, self.tier, self.changed, self.below, self.last, self.score = rules, tier, changed, below, last, score

    def row(self) -> tuple:
        return self.tier, self.changed, self.below, self.last, self.score

    def _settled(self, t: int) -> bool:
        return self.changed is None or t - self.changed >= self.rules.hold_ms

    def _change(self, t: int, tier: int, reason: str) -> tuple:
        out = (t, self.tier, tier, reason, self.score)
        self.tier, self.changed = tier, t
        return out

    def next_stale(self) -> int | None:
        """When silence will take it a tier down; None while it can't."""
        if self.rules.stale_ms is None or self.tier <= 1 or self.last is None:
            return None
        due = self.last + self.rules.stale_ms
        return due if self.changed is None else max(due, self.changed + self.rules.hold_ms)

    def advance(self, to: int) -> Iterator[tuple]:
        """Changes (ts_ms, from, to, reason, score) that silence brings up to a time."""
        while (due := self.next_stale()) is not None and due <= to:
            yield self._change(due, self.tier - 1, "stale")

    def hear(self, t: int, score: float) -> Iterator[tuple]:
        """Changes that a score brings, after those of the silence before it: one tier up at once, unless it changed less
        than the hold ago; one down after it has stayed below the line for as long as the hold."""
        yield from self.advance(t)
        self.score, self.last = score, t
        wanted = 1 + sum(score >= bound for bound in self.rules.up)
        if wanted >= self.tier:
            self.below = None
            if wanted > self.tier and self._settled(t):
                yield self._change(t, self.tier + 1, "score")
        elif score >= self.rules.down[self.tier - 2]:
            self.below = None
        elif self.below is None:
            self.below = t
        elif t - self.below >= self.rules.hold_ms:
            self.below = None
            if self._settled(t):
                yield self._change(t, self.tier - 1, "score_decay")


@dataclass(frozen=True)
class PoolRules:
    """A pool has `capacity` seats for scores of at least `floor`; a seat changes hands for a score higher by more than
    `margin`; whoever was seated or left stays so for hold_ms."""

    capacity: int
    floor: float
    margin: float = 0.08
    hold_ms: int = 0


class PoolState:
    """One pool: the score and last change of those it has heard of, and who is seated."""

    def __init__(self, rules: PoolRules, members: dict[int, tuple[float, int | None, bool]] | None = None):
        self.rules, self.members = rules, members or {}

    def snapshot(self, t: int, scores: dict[int, float]) -> Iterator[tuple]:
        """Changes (ts_ms, symbol, event, score) at one instant: seats of scores below the floor are given up, free seats go to
        the highest scores, then the strongest that wait replace the weakest by more than the margin. Ties go to the smaller
        symbol. Who isn't in the snapshot keeps the score it had."""
        for symbol, score in scores.items():
            _, changed, seated = self.members.get(symbol, (0.0, None, False))
            self.members[symbol] = (score, changed, seated)
        settled = {s for s, (_, changed, _) in self.members.items() if changed is None or t - changed >= self.rules.hold_ms}

        def move(symbol: int, seated: bool, event: str) -> tuple:
            score = self.members[symbol][0]
            self.members[symbol] = (score, t, seated)
            settled.discard(symbol)
            return t, symbol, event, score

        for symbol in sorted(s for s in settled if self.members[s][2] and self.members[s][0] < self.rules.floor):
            yield move(symbol, False, "left")
        waiting = sorted((s for s in settled if not self.members[s][2] and self.members[s][0] >= self.rules.floor), key=lambda s: (-self.members[s][0], s))
        free = self.rules.capacity - sum(seated for _, _, seated in self.members.values())
        for symbol in waiting[: max(free, 0)]:
            yield move(symbol, True, "seated")
        for symbol in waiting[max(free, 0) :]:
            weakest = min((s for s, (_, _, seated) in self.members.items() if seated), key=lambda s: (self.members[s][0], -s), default=None)
            if weakest is None or weakest not in settled or self.members[symbol][0] <= self.members[weakest][0] + self.rules.margin:
                break
            yield move(weakest, False, "evicted")
            yield move(symbol, True, "seated")


class _Ordered(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then deals them out in order; one timer a key says when next."""

    rows_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getListState("waiting", self.rows_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        new = [tuple(x) for pdf in rows for x in self.columns(pdf).itertuples(index=False)]
        self.waiting.appendList(new)
        self._wake(min(t for t, *_ in new), timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        out, wake = self.deal(key[0], due, now)
        nexts = [t for t in (wake, later[0][0] if later else None) if t is not None]
        if nexts:
            self._wake(min(nexts), timerValues)
        yield pd.DataFrame(out, columns=self.out_columns)

    def _wake(self, at: int, timer_values) -> None:
        self.handle.registerTimer(max(at, timer_values.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


#: Neighbouring symbols that the tier machine's stream keeps in one group: state and timers are asked for once a group.
TOGETHER = 64


class _TierProcessor(_Ordered):
    """The symbols of one group, each with a state of its own."""

    rows_schema, out_columns = "ts_ms long, tie long, symbol long, score double", [c.split()[0] for c in CHANGES.split(", ")]

    def __init__(self, rules: TierRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.states = handle.getListState("tiers", f"symbol long, {TierState.FIELDS}")

    def columns(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["ts_ms", "tie", "symbol", "score"]]

    def deal(self, group: int, due: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        states = {symbol: TierState(self.rules, *row) for symbol, *row in self.states.get()}
        out = []
        for t, _, symbol, score in due:
            if symbol not in states:
                states[symbol] = TierState(self.rules)
            out += [(symbol, *c) for c in states[symbol].hear(t, score)]
        for symbol, state in states.items():
            out += [(symbol, *c) for c in state.advance(now)]
        self.states.put([(symbol, *state.row()) for symbol, state in states.items()])
        return out, min((t for state in states.values() if (t := state.next_stale()) is not None), default=None)


class _PoolProcessor(_Ordered):
    rows_schema, out_columns = "ts_ms long, symbol long, score double", [c.split()[0] for c in SEATS.split(", ")]

    def __init__(self, rules: PoolRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.members = handle.getMapState("members", "symbol long", "score double, changed long, seated boolean")

    def columns(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["ts_ms", "symbol", "score"]]

    def deal(self, pool: int, due: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        state, out = PoolState(self.rules, {k[0]: tuple(v) for k, v in self.members.iterator()}), []
        before = dict(state.members)
        for t in sorted({x[0] for x in due}):
            out += state.snapshot(t, {s: score for at, s, score in due if at == t})
        for symbol, value in state.members.items():
            if before.get(symbol) != value:
                self.members.updateValue((symbol,), value)
        return [(pool, *c) for c in out], None


def _streamed(rows: DataFrame, key: str, processor: _Ordered, schema: str, delay: str) -> DataFrame:
    timed = rows.withColumn("event_time", F.timestamp_millis(F.col("ts_ms"))).withWatermark("event_time", delay)
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def tier_machine_stream(scores: DataFrame, rules: TierRules, delay: str = "10 minutes") -> DataFrame:
    """Tier changes of a stream of scores (symbol, ts_ms, tie, score), as tier_machine gives them up to the watermark.

    Rows may come in any order within the delay. Silence is noticed by a timer, without another row of the symbol. Needs the
    RocksDB state store. Groups are of TOGETHER neighbouring symbols, so they grow in number and not in symbols."""
    grouped = scores.withColumn("__group", F.expr(f"symbol div {TOGETHER}"))
    return _streamed(grouped, "__group", _TierProcessor(rules), CHANGES, delay)


def pool_seats_stream(scores: DataFrame, rules: PoolRules, delay: str = "10 minutes") -> DataFrame:
    """Seat changes of a stream of scores (pool, ts_ms, symbol, score), as pool_seats gives them up to the watermark."""
    return _streamed(scores, "pool", _PoolProcessor(rules), SEATS, delay)


def tier_machine(scores: DataFrame, rules: TierRules, until_ms: int) -> DataFrame:
    """(symbol, ts_ms, from_tier, to_tier, reason, score): tier changes of a table of scores (symbol, ts_ms, tie, score) up to a
    time, in order of time and tie.

    Rows are sorted within partitions and streamed through the rules, so a symbol's rows never are in memory at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, TierState(rules)
        for pdf in batches:
            out = []
            for s, t, score in zip(pdf["symbol"].tolist(), pdf["ts_ms"].tolist(), pdf["score"].tolist(), strict=True):
                if s != symbol:
                    out += [(symbol, *c) for c in state.advance(until_ms)]
                    symbol, state = s, TierState(rules)
                out += [(s, *c) for c in state.hear(t, score)]
            yield pd.DataFrame(out, columns=_TierProcessor.out_columns)
        yield pd.DataFrame([(symbol, *c) for c in state.advance(until_ms)], columns=_TierProcessor.out_columns)

    rows = scores.where(F.col("symbol").isNotNull() & F.col("score").isNotNull() & (F.col("ts_ms") <= until_ms)).select("symbol", "ts_ms", "tie", "score")
    return rows.repartition("symbol").sortWithinPartitions("symbol", "ts_ms", "tie").mapInPandas(run, CHANGES)


def pool_seats(scores: DataFrame, rules: PoolRules, until_ms: int) -> DataFrame:
    """(pool, ts_ms, symbol, event, score): who is seated, leaves or is evicted at each instant of a table of scores (pool,
    ts_ms, symbol, score); of scores of one symbol and instant the largest counts. A task holds one pool's symbols."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = at = None
        state, now, out = PoolState(rules), {}, []
        for pdf in batches:
            for p, t, s, score in zip(*(pdf[c].tolist() for c in ("pool", "ts_ms", "symbol", "score")), strict=True):
                if now and (p != pool or t != at):
                    out += [(pool, *c) for c in state.snapshot(at, now)]
                    now = {}
                if p != pool:
                    state = PoolState(rules)
                pool, at, now[s] = p, t, score
            yield pd.DataFrame(out, columns=_PoolProcessor.out_columns)
            out = []
        yield pd.DataFrame([(pool, *c) for c in state.snapshot(at, now)] if now else [], columns=_PoolProcessor.out_columns)

    rows = scores.where(F.col("pool").isNotNull() & F.col("symbol").isNotNull() & F.col("score").isNotNull() & (F.col("ts_ms") <= until_ms))
    return rows.select("pool", "ts_ms", "symbol", "score").repartition("pool").sortWithinPartitions("pool", "ts_ms", "symbol", "score").mapInPandas(run, SEATS)
