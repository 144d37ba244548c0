"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.storage import cut


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One contraction: each node hands its neighbours (``both``: the larger ones) its smallest neighbour."""
    if both:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if both:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        out = joined.select(F.col("v").alias("b"), F.col("m").alias("a")).union(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return out.where(F.col("a") != F.col("b")).select("a", "b").distinct()


def components(edges: DataFrame, rounds: int = 60, cut=cut) -> DataFrame:
    """node, component (the smallest node that it reaches) for each node of edges (a, b), both long.

    Large-star and small-star steps alternate until the edges stay the same; each step is stored, so
    lost executors cost one step (by ``cut``, of which an operator may pass its own).  Self loops and repeated edges are allowed; no edges give no rows.
    """
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = cut(_stars(_stars(now, True), False), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a")).distinct()
