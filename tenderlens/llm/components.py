"""Connected components of an edge table by alternating star contraction.

A large-star step links every larger neighbour of a node to the node's smallest
neighbour; a small-star step links the node and its smaller neighbours to the
smallest.  Each round is a grouping and a join; edges never gather per node, and
the skewed side of a join may be split.  Rounds grow as the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed

MAX_ROUNDS = 60
SALTS = 16


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with their a's `m`. A node may hold a third of all edges, so its edges are dealt over SALTS tasks, each with a copy of its m."""
    left = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    right = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    return _with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of edges (a, b) with the smallest node of its component."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _fingerprint(edges)
    for _ in range(MAX_ROUNDS):
        edges = checkpointed(_small_star(_large_star(edges)))
        state, last = _fingerprint(edges), state
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
