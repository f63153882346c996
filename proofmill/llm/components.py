"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), the component being its smallest node.

    Each step rewires every node's neighbours to the smallest node it can see; after few steps (logarithmic in the longest
    path) each node hangs on its component's smallest. Minima are aggregated before the shuffle, so a node with very many
    neighbours costs one row per task. Every step is written to the shared folder, so lineage stays short.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not all_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        lowest = larger.groupBy("a").agg(F.min("b").alias("least"))
        smaller = larger.join(lowest, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        now = written(smaller.unionByName(lowest.select("a", F.col("least").alias("b"))).distinct(), "edges")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node at most, and none of those has one itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("below")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("below")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("below").alias("below")).where("up > 1 or up = 1 and below = 1").isEmpty()
