"""Connected components of a graph given as a table of links, without ever gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import checkpointed


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour."""
    both = links.select(F.col("u").alias("s"), F.col("v").alias("t")).union(links.select("v", "u"))
    least = checkpointed(both.groupBy("s").agg(F.least(F.min("t"), F.col("s")).alias("m")))
    return both.join(least, "s").where("t > s").select(F.col("t").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    least = checkpointed(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (u, v: long); root is the smallest node it reaches.

    Alternates large-star and small-star steps until a step changes nothing, which takes about the
    logarithm of the longest chain. Each step only takes minima by node, so a node with very many
    links is a partial aggregate, not a list. Minima are written out before they are joined, so that
    Spark can split a node that very many links share. Every round is checkpointed, so a lost executor
    costs one round. No links give an empty result.
    """
    now = checkpointed(_oriented(links))
    state = None
    while True:
        # order-free digest of the links: a step that changes nothing ends the loop
        row = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("a"),
            F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b"),
        ).first()
        if row["n"] == 0 or tuple(row) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = tuple(row)
        now = checkpointed(_small_star(checkpointed(_large_star(now))))
