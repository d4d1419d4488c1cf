"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Edges that one task of a round takes: small graphs don't spread over as many files as a shuffle has partitions.
EDGES_A_TASK = 20_000


def _least(edges: DataFrame, parts: int) -> DataFrame:
    """(u, m): the least neighbour of each u, summed up before it is shuffled and written, so that
    the join with it is a plain join of two shuffled tables, whose large partitions Spark splits."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "least")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood and itself."""
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    `edges` are undirected pairs of 64-bit ids; rows with a null end and loops are ignored, and
    repeated pairs count once. The stars keep every edge as a row (u, v) with u > v; no step makes
    more edges than it got. Each step is written to the shared folder, so that a lost executor
    costs one step, and what it was made from is deleted. A node with many neighbours is split
    where it meets its least one. An empty table gives an empty table.
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    now = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(u.isNotNull() & v.isNotNull() & (u != v)).distinct(), "edges")
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    state = tuple(now.agg(F.count("*"), F.sum(mark)).first())
    for _ in range(most_rounds):
        parts = 1 + state[0] // EDGES_A_TASK
        near = _least(_both(now.coalesce(parts)), parts)
        large = stored(_large_star(now.coalesce(parts), near).coalesce(parts).distinct().coalesce(parts), "edges")
        below = _least(large, parts)
        small = stored(_small_star(large, below).coalesce(parts).distinct().coalesce(parts), "edges")
        discard(now, near, large, below)
        before, state, now = state, tuple(small.agg(F.count("*"), F.sum(mark)).first()), small
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
