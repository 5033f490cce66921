"""Connected components by alternating large-star and small-star steps (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MAX_ROUNDS = 100


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of an edge ``u, v``; the root is the smallest node.

    Each round is a pair of aggregations and joins over the edges and goes to the shared
    folder. A node that a third of all edges touch is aggregated map-side; the minima are
    written before they are joined, which leaves the join free to split it. Ends when a round
    changes no edge.
    """
    e = shared.materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = shared.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared.materialize(large, "large-star")
        low = shared.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select("x.*")
        e = shared.materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
