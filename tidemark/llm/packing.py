"""Packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoder
from tidemark.llm.common import id_text, materialise, shuffle_partitions, typed_ids

#: The share of each length's demand that the program may leave uncovered, and how far below the best a pattern's price
#: may lie for it to be used in the same round.
EPSILON, NEAR = 0.05, 0.02


class _Knapsack:
    """The most valuable filling of each room up to the capacity: an unbounded knapsack by dynamic programming.

    lengths ascend. A small gain for each token lets full sequences win among equals."""

    def __init__(self, prices: np.ndarray, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        gain = prices + lengths * (prices.max() * 1e-6 / capacity)
        self.best, self.chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for room in range(lengths[0], capacity + 1):
            k = fits[room]
            worth = self.best[room - lengths[:k]] + gain[:k]
            j = k - 1 - int(worth[::-1].argmax())  # the longest among equals
            self.best[room], self.chosen[room] = worth[j], j
        self.worth = gain + self.best[capacity - lengths]  # of the best pattern with each length

    def pattern(self, i: int) -> np.ndarray:
        """How many of each length the best pattern with length i takes."""
        counts, room = np.zeros(len(self.lengths), dtype=np.int64), self.capacity - self.lengths[i]
        counts[i] = 1
        while (j := self.chosen[room]) >= 0:
            counts[j] += 1
            room -= self.lengths[j]
        return counts


def covering(demand: dict[int, int], capacity: int) -> dict[tuple, float]:
    """Patterns ((length, how often), ...) and how many sequences of each the configuration program uses.

    The program: as few sequences as possible, one variable a pattern, so that each length is covered as often as it
    occurs. Multiplicative weights price the lengths, a knapsack finds the best pattern for each length, and those within
    NEAR of the most price are used until one of their lengths is covered; what a round covers of a length's demand lowers
    its price by that power of e. No length is covered more often than it occurs, so all of a full pattern is of use.
    Ends when every length is covered but for EPSILON of it: each round covers one length at least."""
    lengths, wanted = np.array(sorted(demand)), np.array([demand[x] for x in sorted(demand)], dtype=float)
    prices, left, uses = lengths / capacity, wanted.copy(), {}
    while len(k := np.flatnonzero(left > EPSILON * wanted)):
        knapsack = _Knapsack(prices[k], lengths[k], capacity)
        rest, need, done = left[k], EPSILON * wanted[k], np.zeros(len(k))
        # those of long pieces first: short ones fit in later just as well
        for i in np.flatnonzero(knapsack.worth >= (1 - NEAR) * knapsack.worth.max())[::-1]:
            if rest[i] <= need[i]:
                continue
            counts = knapsack.pattern(i)
            used = np.flatnonzero(counts)
            if (rest[used] > need[used]).all():
                amount = float((rest[used] / counts[used]).min())
                rest[used] -= amount * counts[used]
                done[used] += amount * counts[used]
                pattern = tuple((int(lengths[k[j]]), int(counts[j])) for j in used)
                uses[pattern] = uses.get(pattern, 0.0) + amount
        left[k] = rest
        prices[k] *= np.exp(-done / wanted[k])
    return uses


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns filled largest first, each as often as the rest allows."""
    left, out = dict(left), []
    while rest := [x for x in sorted(left, reverse=True) if left[x]]:
        pattern, room = {}, capacity
        for length in rest:
            if n := min(room // length, left[length]):
                pattern[length] = n
                room -= n * length
        times = min(left[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            left[x] -= times * n
        out.append((pattern, times))
    return out


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: how often}, how many sequences) that together hold the histogram's pieces exactly."""
    program, rest = split(histogram, capacity)
    return program + rest


def split(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], list[tuple[dict[int, int], int]]]:
    """(patterns from the configuration program, patterns of the best fit for what rounding leaves).

    Amounts are rounded down, those below one up, the largest first, as long as the pieces last; patterns that leave
    more than NEAR of a sequence empty wait. The program is then solved again for the pieces left, until it places less
    than a twentieth of them or a few sequences are left. Last, see _repaired. The patterns are bounded by lengths and rounds, not by pieces."""
    left = {length: n for length, n in sorted(histogram.items()) if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    if n := left.pop(capacity, 0):
        out.append(({capacity: 1}, n))
    volume = lambda: sum(x * n for x, n in left.items())
    while (before := volume()) > 4 * capacity:
        taken = 0
        for pattern, amount in sorted(covering({x: n for x, n in left.items() if n}, capacity).items(), key=lambda x: (-min(x[1], 1), -x[0][-1][0], -x[1])):
            size = sum(x * n for x, n in pattern)
            times = min([max(int(amount), 1), *(left[x] // n for x, n in pattern)])
            if times and (size >= (1 - NEAR) * capacity or not taken):
                for x, n in pattern:
                    left[x] -= times * n
                out.append((dict(pattern), times))
                taken += times * size
        if taken < 0.05 * before:
            break
    return _repaired(out, left, capacity)


def _repaired(program: list[tuple[dict[int, int], int]], left: dict[int, int], capacity: int):
    """The program's patterns and the best fit for the rest, where up to half of the program's sequences, the least full
    ones, are packed anew with the rest if that takes fewer."""
    size = lambda pattern: sum(x * n for x, n in pattern.items())
    program = sorted(program, key=lambda x: -size(x[0]))
    total = sum(n for _, n in program)
    plans = []
    for share in (0.0, 0.02, 0.05, 0.1, 0.25, 0.5):
        back, rest, kept = int(share * total), dict(left), []
        for pattern, n in reversed(program):
            undone = min(n, back)
            back -= undone
            for x, k in pattern.items():
                rest[x] = rest.get(x, 0) + undone * k
            kept += [(pattern, n - undone)] if n > undone else []
        plans.append((kept, _best_fit(rest, capacity)))
    return min(plans, key=lambda plan: sum(n for part in plan for _, n in part))


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, blocks: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, block): each text's ids and end_id, cut into pieces of `capacity`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, end = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for i, ids in zip(pdf["id"].tolist(), coder.encode_all(pdf["text"]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    pieces = texts.mapInPandas(run, "id string, piece int, start long, length long, ids_crc32 long")
    return typed_ids(pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)).cast("int")), docs, id_col)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): a place for each piece of each document.

    A null text counts as empty, so it is one piece that holds end_id alone. Only the histogram of lengths, `capacity`
    rows at most, reaches the driver, and only the patterns, bounded as well, go back. Pieces of one length are
    numbered through blocks of ids, so that a length that many share is counted by many tasks. Repeated rows are
    pieces of their own; other columns are ignored; an empty table gives no rows."""
    blocks = 8 * shuffle_partitions(docs.sparkSession)
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, end_id, blocks, id_col, text_col), "pieces")
    counts = materialise(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # (length, first rank, pieces of it in a sequence, first sequence, place in the sequence)
    plan, taken, first = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in solve(histogram, capacity):
        at = 0
        for length, n in sorted(pattern.items(), reverse=True):
            plan.append((length, taken[length], n, first, at))
            taken[length] += n * times
            at += n * length
        first += times
    plan = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy(id_col, "piece")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["length", "block"])
        .select(id_text(id_col), "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.rec.fromarrays(plan[:, :2].T, names="length,rank")
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            row = plan[np.searchsorted(order, np.rec.fromarrays([length, rank], names="length,rank"), "right") - 1]
            turn = rank - row[:, 1]
            yield pdf.drop(columns="rank").assign(sequence_id=row[:, 3] + turn // row[:, 2], offset=row[:, 4] + turn % row[:, 2] * length)

    placed = ranked.mapInPandas(place, "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return typed_ids(placed, docs, id_col)
