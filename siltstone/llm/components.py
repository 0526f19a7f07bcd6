"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Each step attaches neighbours to the least of them; the edges that are left in the end join every node to the least of
its component. A step is one aggregation and one join of the edge table, written out each round, so no node's whole
neighbourhood is ever in one task and nothing reaches the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b): for each a, attach its neighbours (the larger ones, or all of the smaller) to the least around."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("least"))
    near = edges.join(least, "a")
    if large:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        own = least.select("a", F.col("least").alias("b"))
        out = near.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own)
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the least node of the component."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs, seen = staged(pairs, "edges"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        grown = staged(_star(both, large=True), "stars")
        pairs = staged(_star(grown, large=False), "edges")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = pairs.select("b").distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
