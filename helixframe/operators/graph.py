"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def edge_table(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The distinct edges (a, b) between two nodes, a the greater one, as a written table."""
    return written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node with an edge to another; component is its least node."""
    return star_steps(edge_table(edges, a, b))


def star_steps(now: DataFrame) -> DataFrame:
    """The components of an edge table.

    Large-star and small-star steps alternate until the edges stay the same; each step is
    written, so neither plans nor lineage grow, and the driver sees two numbers a step.
    """
    before = None
    while True:
        both = now.union(now.select("b", "a")).toDF("n", "m")
        least = both.groupBy("n").agg(F.min("m").alias("r")).select("n", F.least("n", "r").alias("r"))
        large = both.join(least, "n").where("m > n AND m <> r").select(F.col("m").alias("a"), F.col("r").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("r"))
        small = large.join(lower, "a").where("b <> r").select(F.col("b").alias("a"), F.col("r").alias("b")).union(lower.select("a", "r")).distinct()
        now = written(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(seen):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before = tuple(seen)
