"""Connected components over an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows (itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _neighbour_minimum(both).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    low = _neighbour_minimum(edges)
    moved = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges of orderable ids -> (node, label), label the least id reachable.

    Nodes without an edge do not appear. Null ends, loops and repeated edges are ignored;
    an empty edge table gives an empty result. Every round is checkpointed, so a lost
    executor costs one round. Only a count and a checksum reach the driver. Raises if the
    contraction has not settled after max_rounds (it takes about log of the diameter).
    """
    state = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = tuple(state.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if mark == seen or not mark[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        seen = mark
        state = cut(_small_star(_large_star(state)))
    raise RuntimeError("components did not settle")
