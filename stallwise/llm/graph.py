"""Connected components of a graph of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_shuffles


#: Up to so many edges (16 to 40 MB) are worked on as one partition, where groupings and joins need no shuffle.
ONE_PARTITION = 500_000


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, root`` for each node of ``links`` (columns ``a, b``); the root is a component's least node.

    Alternates two star contractions: each node ties its larger neighbours to the
    least node it knows, then its smaller ones.  Each is a minimum per node, which
    partial aggregation takes care of however many links a node has, and a join.
    Rounds grow with the logarithm of the longest path; more than ``max_rounds`` are an error.
    The number of edges never grows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = _mark(edges)
    for step in range(max_rounds):
        if step % 4 == 3:
            free_shuffles(links.sparkSession)
        if mark[0] <= ONE_PARTITION:
            edges = edges.coalesce(1)
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(tied.union(least).distinct())
        mark, old = _mark(edges), mark
        if mark == old:
            break
    else:
        raise RuntimeError(f"components haven't converged in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """A digest of a set of edges: equal for equal sets, in any order."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
