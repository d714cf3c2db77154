"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.llm.store import Workspace


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``; the component is its least node.

    Each round runs a large star (every neighbour above a node is tied to the node's least
    neighbour) and a small star (the same for neighbours below). Both are a minimum per node,
    combined before the shuffle, and a join back, so a node with very many links is never
    gathered in one place. It ends when the links no longer change.
    """
    links = work.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .where("a < b").distinct())
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.keep(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("m").alias("a"), F.col("b")).where("a < b").distinct())
        large = work.keep(large)
        least = work.keep(large.groupBy("b").agg(F.min("a").alias("m")))
        joined = large.join(least, "b")
        small = (joined.select(F.col("m").alias("a"), F.col("b"))
                 .union(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct())
        links = work.keep(small)
        after = _state(links)
        if after == before:
            break
        before = after
    return (links.select(F.col("b").alias("node"), F.col("a").alias("component"))
            .union(links.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct())
