"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import checkpoint, spread_lookup


def _smallest(links: DataFrame) -> DataFrame:
    """(a, m): the smallest neighbour of every a, itself included."""
    return links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Alternates two steps until nothing changes: larger neighbours move to a node's smallest
    neighbour, then smaller neighbours do. Links only ever shrink to one per node, the number
    of rounds grows with the logarithm of the longest path, and each round is checkpointed.
    A hub's links are dealt out by salt.
    """
    links = checkpoint(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            spread_lookup(both.where("b > a"), _smallest(both), ["a"], F.col("b"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        low = _smallest(large)
        small = (
            spread_lookup(large, low, ["a"], F.col("b"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        links = checkpoint(small)
        mixed = F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 31) - 1))
        now = tuple(links.agg(F.count("*"), F.sum(mixed)).first())
        if now == state:
            break
        state = now
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
