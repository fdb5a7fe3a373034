"""Connected components by alternating large and small stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ruletrace.llm.common import settled


def _open(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or one smaller and one larger; else all edges are stars of roots."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    sides = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return bool(sides.agg(F.count_if(F.expr("ups > 1 OR (ups = 1 AND least = 0)"))).first()[0])


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of ``edges`` (columns a and b) that is no root.

    A node may have very many neighbours: minima are pre-aggregated, and they are written down before
    they meet the edges, so that the join's sides can be split.
    """
    a, b = F.col("a"), F.col("b")
    now = settled(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while _open(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settled(both.groupBy(F.col("u").alias("of")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "star")
        large = settled(both.join(least, F.col("u") == F.col("of")).where("v > u")
                        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = settled(large.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m")), "star")
        small = large.join(least, F.col("u") == F.col("of")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(small.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
