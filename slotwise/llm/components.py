"""Connected components of a graph of links, by alternating large-star and small-star rounds.

Every round is an aggregate and a join per star, so no node's links meet in one task unsplit; its edges are written to
the shared folder, which cuts the lineage, and those of the round before are deleted. Rounds grow with the logarithm of
the number of nodes. Links of a node with itself or with null are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import drop_stored, store


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_low"))


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is named by its least node."""
    links = links.filter("a <> b")
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).withColumn("_low", F.least("_u", "_low"))
        large = (both.join(low, F.col("u") == F.col("_u")).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("_low").alias("v")).distinct())
        low = _least(large)
        small = large.join(low, F.col("u") == F.col("_u")).filter("v <> _low").select(F.col("v").alias("u"), F.col("_low").alias("v"))
        new = store(small.unionByName(low.select(F.col("_u").alias("u"), F.col("_low").alias("v"))).distinct(), "edges")
        drop_stored(edges)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
