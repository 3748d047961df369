"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toponexus.llm.storage import keep


def spanning_pairs(pairs: np.ndarray) -> np.ndarray:
    """Pairs (least of its component, member) with the same components as ``pairs``, for one machine's share."""
    if not len(pairs):
        return pairs
    nodes, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(pairs.shape).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[root[member]], nodes[member]], axis=1)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of them and itself: the larger ones, or the smaller ones and itself."""
    ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        ways = ways.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = ways.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        ways = ways.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = ways.groupBy("u").agg(F.min("v").alias("m"))
        out = ways.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows (node, root) for each node of links (a, b): root is the least node of its component.

    The number of rounds grows with the logarithm of the longest chain. Each round ends in a
    checkpoint, and convergence is told by counts and a sum of hashes, so nothing but three numbers
    reaches the driver.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    def state(frame: DataFrame):
        return frame.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a") % 1_000_033), F.lit(0))).first()

    before = None
    for _ in range(rounds):
        edges = keep(_star(_star(edges, large=True), large=False))
        now = state(edges)
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
