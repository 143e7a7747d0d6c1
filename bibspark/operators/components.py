"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.staging import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, root) for each node of an edge; root is the least node that it reaches.

    Two contractions alternate: every node links its larger neighbours to its least one, then
    every node links its smaller neighbours and itself to the least. The edge count never
    grows, the depth shrinks geometrically, and each round is written to the shared folder, so
    lineage stays short. Nodes are compared in their column's order; null nodes are dropped.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = staged(now.select(lo.alias("lo"), hi.alias("hi")).distinct(), name)
    while not _stars(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and m <> v").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = staged(large, name)
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(below, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        now = staged(small.union(below.select(F.col("m").alias("lo"), "hi")).distinct(), name)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up")).union(edges.select(F.col("lo").alias("n"), F.lit(0).alias("up")))
    odd = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
    return odd.isEmpty()
