"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.runtime import drop, settle


def _stars(edges: DataFrame) -> bool:
    """Whether every node with an edge to a smaller one has just that edge, and no edge from a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up = 1 AND down > 0)")
    return not odd.limit(1).count()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    Each round is two joins on the node id, so a node with very many neighbours is an ordinary
    skewed join key (partial minimum before the shuffle, AQE splits the join) and is never
    collected into one row. Rounds grow with the logarithm of the longest path. Edges are written compressed, so the planner
    takes them for small; the joins are told not to send a side through the driver.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = settle(e)
    for _ in range(max_rounds):
        if _stars(e):
            break
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # an edge (u > v) seen from v sends u to m(v); seen from u it sends nothing larger
        large = (
            e.join(least.hint("merge"), e.v == least.k)
            .select(F.col("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(low.hint("merge"), large.u == low.k)
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        old, e = e, settle(small)
        drop(old)
    else:
        raise RuntimeError("components did not settle")
    # now every node points straight at its root
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots)
