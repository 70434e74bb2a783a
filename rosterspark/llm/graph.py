"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_least, materialize

MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Each round hangs neighbours on smaller and smaller nodes, until every node hangs on the smallest it can reach; that
    takes about the logarithm of the longest path in rounds. Neighbour minima are aggregated on the map side and joined
    back by node and salt, so the edges of a node of any degree are spread over tasks. Each half of a round is a written
    table in the shared folder: as each reads its input several times, both in one plan joined 16 times instead of four,
    and the driver plans anew after every stage. Loops and repeated edges are allowed; an empty table gives an empty result.
    """
    stars = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _are_stars(stars):
            break
        stars = materialize(_small_star(materialize(_large_star(stars), "large-stars")), "stars")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, on which nothing but others hang: then components are found."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return counted.where((F.col("hangs") > 1) | (F.col("hangs") + F.col("holds") > 1)).isEmpty()


def _large_star(stars: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest of itself and all its neighbours."""
    both = stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    joined = join_least(both, "a", "b", "low").where("b > a")
    return joined.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    joined = join_least(stars, "a", "b", "low")
    low = F.col("low").alias("b")
    return joined.select(F.explode(F.array(F.struct("a", low), F.struct(F.col("b").alias("a"), low))).alias("e")).select("e.*").where("a != b").distinct()
