"""Connected components by alternating stars: groupings and joins of an edge table only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylode.llm.common import forget, written


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, to a node that has none: its root."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) to (node, root): the smallest node that each node with an edge reaches.

    Large-star hooks a node's larger neighbours to its smallest one, small-star its smaller ones;
    in a number of rounds that grows with the logarithm of the longest path all edges lead to a
    root. Minima are pre-aggregated; the joins with them meet a hub's edges by its name, so a hub of
    very many edges is split by Spark's handling of skewed joins. Tables of past rounds are deleted.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(hooked.unionByName(least.withColumnRenamed("m", "v")).distinct())
        forget(e, large)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
