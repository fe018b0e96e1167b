"""Approximate nearest neighbours by collision counting over query-centred windows of single projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Rows and bytes of a block at most (on average: rows are dealt by hash), and queries that it meets at once.
BLOCK, BLOCK_BYTES, QUERIES = 8192, 1 << 23, 4096
#: Rows that the cells are fitted on, and cells, at most. Every row is indexed, in the cell that it falls into.
SAMPLE, CELLS = 16_384, 512
#: Projections at least (whole orthonormal bases of the space, where it has no more dimensions); the final radius over
#: the distance of the k-th neighbour; the share of vectors at just that distance that may stay below the collision
#: threshold; and the growth of the radius from round to round.
LINES, REACH, MISSED, GROWTH = 128, 1.5, 0.05, 1.15


class Lines:
    """Random projections on which a difference of length s falls with deviation s, and the collision threshold.

    `least` is the number of windows of radius REACH * s that a vector at distance s falls into with probability
    1 - MISSED at least, by simulation with a fixed seed. Orthonormal lines make that number vary less."""

    def __init__(self, dims: int, lines: int = LINES, seed: int = 0):
        rng, bases, left = np.random.default_rng(seed), [], max(lines, dims if dims <= lines else 0)
        while left > 0:
            base = np.linalg.qr(rng.standard_normal((dims, min(dims, lines))))[0]
            bases.append(base)
            left -= base.shape[1]
        self.matrix = np.hstack(bases) * np.sqrt(dims)
        ways = rng.standard_normal((4000, dims))
        ways /= np.linalg.norm(ways, axis=1, keepdims=True)
        hits = (np.abs(ways @ self.matrix) <= REACH).sum(axis=1)
        self.least = max(1, int(np.quantile(hits, MISSED)))

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.matrix


class BlockIndex:
    """Sorted projections of one block's vectors.

    A query's window on each line reaches `reach` to both sides; a wider radius only moves the windows' ends (virtual
    rehashing), and what the windows gain is counted. Vectors in `least` windows or more are verified."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: Lines):
        self.ids, self.vectors, self.lines = ids, vectors, lines
        projected = lines.project(vectors)
        order = np.argsort(projected, axis=0, kind="stable")
        # the lines' sorted arrays lie end to end, each moved beyond the last, so that one search finds all windows' ends
        self.bound = float(np.abs(projected).max(initial=0)) + 1
        self.shift = np.arange(projected.shape[1]) * 4 * self.bound
        self.sorted = (np.take_along_axis(projected, order, axis=0) + self.shift).T.ravel()
        self.order = order.T.ravel()

    def nearest(self, query_id: int, query: np.ndarray, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, ids, how many were verified) of the k nearest found no farther than about `bound`, by distance, then
        id; the query's own id is left out. The radius grows until it is REACH times the k-th distance found, or bound."""
        n, lines = len(self.ids), len(self.shift)
        at, first, last = self.lines.project(query[None])[0], np.arange(lines) * n, np.arange(1, lines + 1) * n

        def ends(reach: float) -> tuple[np.ndarray, np.ndarray]:
            low = np.searchsorted(self.sorted, np.clip(at - reach, -self.bound, self.bound) + self.shift, "left")
            high = np.searchsorted(self.sorted, np.clip(at + reach, -self.bound, self.bound) + self.shift, "right")
            return np.clip(low, first, last), np.clip(high, first, last)

        floor = 1e-9 * (1 + float(np.abs(at).max()))  # projections of equal vectors may differ by rounding
        # the first windows hold a small share of the block
        mid, want = ends(0.0)[0], max(k, n // 16)
        low, high = np.maximum(mid - want, first), np.minimum(mid + want, last - 1)
        spread = np.minimum(np.abs(self.sorted[high] - self.shift - at), np.abs(self.sorted[low] - self.shift - at))
        radius = min(float(np.median(spread)), REACH * bound) + floor
        counts, verified = np.zeros(n, dtype=np.int64), np.full(n, np.nan)
        begin, end = mid.copy(), mid.copy()
        while True:
            a, b = ends(radius)
            a, b = np.minimum(a, begin), np.maximum(b, end)
            starts, sizes = np.concatenate((a, end)), np.concatenate((begin - a, b - end))
            places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            counts += np.bincount(self.order[places], minlength=n)
            begin, end = a, b
            new = np.flatnonzero((counts >= self.lines.least) & np.isnan(verified))
            if len(new):
                gap = self.vectors[new] - query
                verified[new] = np.sqrt((gap * gap).sum(axis=1))
            found = np.flatnonzero(~np.isnan(verified) & (self.ids != query_id))
            kth = np.partition(verified[found], k - 1)[k - 1] if len(found) >= k else np.inf
            enough = REACH * min(kth, bound) + floor
            if radius >= enough or ((begin == first).all() and (end == last).all()):
                best = found[np.lexsort((self.ids[found], verified[found]))[:k]]
                return verified[best], self.ids[best], int((~np.isnan(verified)).sum())
            radius = min(radius * GROWTH, enough)


class Cells:
    """A tree of splits at medians of the most spread projections, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.splits: list[tuple[int, float, int, int]] = []  # (line, cut, node below, node above); leaves are ~cell
        self.count = 0
        self._grow(sample, cells)

    def _grow(self, rows: np.ndarray, cells: int) -> int:
        line = int(np.ptp(np.quantile(rows, (0.1, 0.9), axis=0), axis=0).argmax()) if len(rows) else 0
        cut = float(np.median(rows[:, line])) if len(rows) else 0.0
        above = rows[:, line] > cut if len(rows) else np.zeros(0, bool)
        if cells < 2 or not above.any() or above.all():
            self.count += 1
            return -self.count
        node = len(self.splits)
        self.splits.append((line, cut, 0, 0))
        below = self._grow(rows[~above], cells // 2)
        self.splits[node] = (line, cut, below, self._grow(rows[above], cells - cells // 2))
        return node

    def of(self, projected: np.ndarray) -> np.ndarray:
        """The cell, from 0, of each row."""
        out = np.zeros(len(projected), dtype=np.int32)
        waiting = [(0, np.arange(len(projected)))] if self.splits else []
        while waiting:
            node, rows = waiting.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            line, cut, below, above = self.splits[node]
            side = projected[rows, line] > cut
            waiting += [(below, rows[~side]), (above, rows[side])]
        return out


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the rows that take part: no null id, no null, zero or non-finite vector, and of the
    most frequent length (the smaller one of two equally frequent)."""
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    clean = clean.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & good)
    width = clean.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return clean.where(F.size(v) == (width["n"] if width else 0))


def _array(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<f8")


def _search(blocks: DataFrame, asked: DataFrame, lines: Lines, k: int, packs: int) -> DataFrame:
    """(query_id, ids, scores, verified, rows): what each query (id, vector, bound, cell, part) finds in its block."""
    dealt = asked.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int"))
    keys = ["cell", "part", "pack"]
    wanted = dealt.select(F.col("cell").alias("c"), F.col("part").alias("p"), "pack").distinct()
    held = blocks.join(wanted, (blocks["cell"] == F.col("c")) & (blocks["part"] == F.col("p"))).select("cell", "part", F.col("pack").alias("pack"), "ids", "vectors")

    def run(index: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(asks):
            ids = np.frombuffer(index["ids"].iloc[0], dtype="<i8")
            block = BlockIndex(ids, _array(index["vectors"].iloc[0]).reshape(len(ids), -1), lines)
            for i, vector, bound in zip(asks["id"].tolist(), asks["vector"], asks["bound"].tolist(), strict=True):
                scores, found, verified = block.nearest(i, np.asarray(vector), k, bound)
                out.append((i, found, scores, verified, len(ids)))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores", "verified", "rows"])

    schema = "query_id long, ids array<long>, scores array<double>, verified long, rows long"
    return held.groupBy(keys).cogroup(dealt.select("id", "vector", "bound", *keys).groupBy(keys)).applyInPandas(run, schema)


def search(
    vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES
) -> DataFrame:
    """(query_id, ids, scores, verified, rows): what each query found in each block that it had to meet, how many vectors
    it verified there, and how many the block holds. See nearest_neighbours."""
    clean = materialise(valid_vectors(vectors, id_col, vector_col), "vectors")
    spark, head = clean.sparkSession, clean.first()
    # of rows that repeat a query's id, the one with the smallest vector asks
    asked = clean.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    total, dims = clean.count(), len(head["vector"]) if head else 1
    lines, size = Lines(dims), max(1, min(block, BLOCK_BYTES // (8 * dims)))
    packs = max(1, -(-asked.count() // queries))
    rows = clean.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE).select("vector").collect() if total > size else []
    cells = Cells(lines.project(np.array([r["vector"] for r in rows])) if rows else np.zeros((0, lines.matrix.shape[1])), min(CELLS, total // size))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=cells.of(lines.project(np.stack(pdf["vector"].to_numpy()))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.stack(pdf["vector"].to_numpy())
        seen = lines.project(held)
        row = (pdf["cell"].iloc[0], pdf["part"].iloc[0], pdf["id"].to_numpy("<i8").tobytes(), held.astype("<f8").tobytes(), seen.min(axis=0), seen.max(axis=0))
        return pd.DataFrame([row], columns=["cell", "part", "ids", "vectors", "low", "high"])

    schema = "id long, vector array<double>, cell int"
    placed = clean.mapInPandas(place, schema)
    parts = materialise(placed.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")), "cells")  # CELLS rows at most
    part = F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", part).drop("parts")
    blocks = materialise(dealt.groupBy("cell", "part").applyInPandas(build, "cell int, part int, ids binary, vectors binary, low array<double>, high array<double>"), "blocks")

    homes = asked.mapInPandas(place, schema).join(F.broadcast(parts), "cell").withColumn("part", part).drop("parts")
    homes = materialise(homes.withColumn("bound", F.lit(float("inf"))), "queries")
    first = materialise(_search(blocks, homes, lines, k, packs), "homes")
    # cells that some block of theirs lets hold a vector with enough collisions; their spans are CELLS rows at most
    line = F.posexplode(F.arrays_zip("low", "high")).alias("line", "x")
    spans = blocks.select("cell", line).groupBy("cell", "line").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    spans = {r["cell"]: r["s"] for r in spans.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("line", "low", "high"))).alias("s")).collect()}
    names = np.array(sorted(spans), dtype=np.int32)
    low, high = (np.array([[s[c] for s in spans[n]] for n in names]).reshape(len(names), lines.matrix.shape[1]) for c in ("low", "high"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, vector, bound in zip(pdf["id"].tolist(), pdf["vector"], pdf["bound"].tolist(), strict=True):
                at, reach = lines.project(np.asarray(vector)[None])[0], REACH * bound + 1e-9
                near = ((low - reach <= at) & (at <= high + reach)).sum(axis=1) >= lines.least
                out += [(i, vector, bound, cell) for cell in names[near]]
            yield pd.DataFrame(out, columns=["id", "vector", "bound", "cell"])

    bounds = first.select(F.col("query_id").alias("id"), F.when(F.size("scores") >= k, F.element_at("scores", -1)).otherwise(float("inf")).alias("bound"))
    others = (
        homes.select("id", "vector").join(bounds, "id")
        .mapInPandas(meet, "id long, vector array<double>, bound double, cell int")
        .join(F.broadcast(parts), "cell")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .drop("parts")
        .join(homes.select("id", "cell", "part"), ["id", "cell", "part"], "left_anti")
    )
    return first.unionByName(_search(blocks, others, lines, k, packs))


def nearest_neighbours(
    vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each query, by Euclidean distance in double precision.

    is_query: a condition over column `id` that names the queries. Every valid row is a candidate but those with the
    query's own id. Rows fall into cells of near projections, and a cell's rows are dealt into blocks of bounded size by
    a hash, so that many equal vectors are spread. A query first widens its windows in one block of its own cell, until
    they reach well beyond the k-th neighbour found. That distance bounds all further windows, so that only cells are
    met in which a vector can still have enough collisions, and only vectors that have them are verified. Where data
    have no clusters that is every cell: each query meets all rows, in blocks.

    Ties go to the smaller id. Rows that repeat an id are candidates of their own; of rows that repeat a query's id the
    one with the smallest vector asks. Fewer than k candidates: all of them that collide. Empty tables and no valid
    queries give no rows."""
    found = search(vectors, is_query, k, id_col, vector_col, block, queries).select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    order = Window.partitionBy("query_id").orderBy("x.scores", "x.ids")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("x.ids").alias(id_col), F.col("x.scores").alias("score"))
