"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())


def _to_minimum(edges: DataFrame, own: bool) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u, or u itself if that is less.

    The minimum is combined before the shuffle; the join back is an ordinary one,
    whose side of a node with very many edges adaptive execution splits.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if own:
        least = least.withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Components of an undirected graph given as long columns a, b.

    Returns (node, root): every node that has an edge to another one, with the least
    node it can reach. Edges may repeat and may point both ways; loops are ignored;
    an empty table gives an empty result. Rounds: about the square of the logarithm of
    the longest path at most; each round's edges are written to the shared folder.
    """
    now = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(most):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, own=True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _to_minimum(large.distinct(), own=False)
        new = (
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = materialize(new, "edges")
        before, state = state, _state(new)
        discard(now)
        now = new
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
