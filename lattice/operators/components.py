"""Connected components of an edge list by alternating large-star and small-star contraction.

Each round is two aggregations with a map-side minimum and two equi-joins, which adaptive execution can split
where a hub is skewed; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.session import cut


def _star(pairs: DataFrame, keep: Column, own: bool) -> DataFrame:
    """pairs (u, v): for each u the least of u and its v; links to it from the v that keep holds for, and from u if own."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    links = pairs.where(keep).join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    if own:
        links = links.unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return links.where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(vertex, component): component is the least vertex reachable, edges taken as undirected.

    Vertices that occur only in self-loops get themselves; edges with a null end are dropped; an empty edge list gives
    no rows. Every vertex of the edge list comes out exactly once. Runs to convergence and raises beyond max_rounds.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    vertices = ends.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    current = cut(ends.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    for _ in range(max_rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, F.col("v") > F.col("u"), own=False)
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        current = cut(_star(down, F.lit(True), own=True).select("a", "b"))
        if _is_star(current):
            labels = current.select(F.col("b").alias("vertex"), F.col("a").alias("component"))
            return vertices.join(labels, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")



def _is_star(links: DataFrame) -> bool:
    """Whether each b has one a and no a is a b: then every component is a star around its least vertex."""
    repeated = links.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("b").alias("v"))
    inner = links.select(F.col("a").alias("v")).join(links.select(F.col("b").alias("v")), "v", "left_semi")
    return repeated.unionByName(inner).isEmpty()
