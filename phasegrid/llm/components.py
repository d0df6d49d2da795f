"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool, sized: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each node's neighbours (large: the greater ones; else the smaller ones and itself) are joined to the least."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return sized(sized(near.where("b > a").join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    moved = sized(near.join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return sized(moved.unionByName(sized(least.select("a", F.col("m").alias("b")))).where("a <> b").distinct())


def components(edges: DataFrame, most: int = 60, each: int | None = None) -> DataFrame:
    """(node, root) for each node of edges(a, b); root is the least node reachable. Self-loops and nulls are ignored.

    each: edges for a task, where they may be few and the session's partitions many.

    Minima are combined before the shuffle, and the join back can be split by adaptive execution, so a
    hub is no single task. Each round's edges are checkpointed; the loop ends when a round changes nothing.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
    tasks = each and edges.count() // each + 1
    sized = lambda e: e.coalesce(tasks) if tasks else e
    before = None
    for _ in range(most):
        edges = cut(_star(_star(edges, True, sized), False, sized))
        if (now := mark(edges)) == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point was reached")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
