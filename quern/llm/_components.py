"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round rewires edges toward smaller neighbours and is one aggregation and one
join; the edge count never grows and the rounds are logarithmic in practice.
Neither edges nor labels reach the driver, only a row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stash import Stash


def components(edges: DataFrame, stash: Stash, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node reachable.

    Rows with a null end and loops are ignored; repeated edges count once; an empty
    table gives an empty one.
    """
    now = stash.put(edges.select("u", "v").filter("u <> v").distinct(), f"{name}-0")
    before, k = _sum(now), 0
    while before[0]:
        k += 1
        after = stash.put(_small_star(_large_star(now, stash, name), stash, name), f"{name}-{k}")
        stash.drop(f"{name}-{k - 1}", f"{name}-large", f"{name}-small")
        state, now = _sum(after), after
        if state == before:
            break
        before = state
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(now.select("v", "v").distinct())


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, stash: Stash, name: str) -> DataFrame:
    """Joins each larger neighbour of a node to the least node of its neighbourhood.

    The least nodes are combined before they are shuffled and then written, so that both sides of the join are plain
    exchanges, of which Spark splits a partition that one node with many neighbours makes large.
    """
    both = edges.union(edges.select("v", "u"))
    least = stash.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-large")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, stash: Stash, name: str) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stash.put(down.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
