"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is two joins and
two aggregations; rounds grow with the logarithm of the longest path. Every round is written to the
shared folder, so a lost executor costs one round at most, and nothing but a row count and a
checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.runtime import drop_materialised, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger neighbours (or its smaller ones and itself) to its smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``edges(u, v)`` of any comparable type to ``(node, root)``: the smallest node that each can reach.

    Nodes without an edge are not in the result; self loops and repeated edges do no harm; an empty
    table gives an empty result.
    """
    now = materialise(edges.select("u", "v").where("u <> v").distinct())
    mark = _mark(now)
    for _ in range(rounds):
        new = materialise(_star(_star(now, True), False))
        drop_materialised(now.sparkSession, now)
        now, before = new, mark
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
