"""Connected components of a graph given by its edges, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of ordered ids -> (node, root) for every node that is not its component's least one.

    Large-star and small-star steps alternate until nothing changes, which takes about log(n) rounds on chains too.
    In a large-star step every node links its greater neighbours to the least node it sees, in a small-star step its
    lesser ones. Each round is checkpointed to the shared folder. Loops and repeated edges don't matter.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = checkpointed(edges), None
    while True:
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = n, total
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = checkpointed(small)
