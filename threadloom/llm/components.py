"""Connected components of a link table, by alternating large and small stars.

Links and labels stay in tables throughout. Every round rewrites the links so
that nodes point at smaller nodes, written to the shared scratch folder, until
every node is a root or has its root as its only neighbour, which is counted
after each round; the number of rounds grows with the logarithm of the longest
chain, and the tables shrink to one link per node. A node with very many links is a skewed join key
on one side only, which adaptive joins split, and a minimum per key elsewhere,
which is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def _settled(links: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or one and a larger one as well: the rounds would change nothing."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").count() == 0


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` (smallest node reachable) of every node that has a link.

    `links` has columns `a` and `b`; self-links, repeated links and either
    direction are allowed. An empty table gives an empty result.
    """
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(now):
        large = _large_star(now).distinct()
        new = stage(_small_star(large).distinct(), "links")
        drop_stage(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
