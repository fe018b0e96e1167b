"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns (node, component): each node of an edge and the smallest node that it can reach.

    edges: (u long, v long); direction, repeats and loops don't matter. Rounds of large-star and small-star: each node
    hands its larger neighbours, then itself and its smaller ones, to the smallest node it knows. Minima are combined
    before the shuffle, and neighbours are joined to them rather than gathered, so a hub's rows can be split among
    tasks. Ends when a round changes nothing; O(log² n) rounds. An empty edge list gives no rows."""
    edges = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = _signature(edges)
    for _ in range(max_rounds):
        # Large star: every neighbour above u goes to the smallest of u and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least"
        )
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = materialise(large, "large")
        # Small star: u and its neighbours below it go to the smallest of them.
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(small.where("u <> v").distinct(), "edges")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
