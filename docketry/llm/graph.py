"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two aggregations to the smallest neighbour and one join on the node; edges only ever shrink towards the smallest
id of their component. A hub, a node with more edges than HUB_EDGES or a HUBS-th of all, has one aggregated row; those rows (HUBS
at most) are broadcast, so its edges stay where they are, and only the edges of other nodes are dealt by key. Rounds are
logarithmic in the diameter; each is written to the shared folder, and nothing but totals reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import settled

#: Edges that make a node a hub, and the most hubs there can be (24 bytes each when broadcast).
HUB_EDGES, HUBS = 64, 100_000


def _totals(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def with_lowest(edges: DataFrame, low: DataFrame, bar: int) -> DataFrame:
    """`edges` (n, w) with m, the smallest id around n; `low` (n, m, edges) is settled and its nodes above `bar` edges are hubs."""
    hubs, rest = low.filter(F.col("edges") > bar).select("n", "m"), low.filter(F.col("edges") <= bar).select("n", "m")
    if hubs.isEmpty():
        return edges.join(rest, "n")
    hubs = F.broadcast(hubs)
    return edges.join(hubs, "n").select("n", "w", "m").unionByName(edges.join(hubs, "n", "left_anti").join(rest, "n").select("n", "w", "m"))


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; `edges` has long columns a and b, in any direction, repeats allowed."""
    e = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = _totals(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most):
        bar = max(HUB_EDGES, 2 * before[0] // HUBS)
        # Large star: neighbours above a node hang on the smallest of its neighbourhood.
        both = e.select(F.col("v").alias("n"), F.col("u").alias("w")).unionByName(e.select(F.col("u").alias("n"), F.col("v").alias("w")))
        low = settled(both.groupBy("n").agg(F.least("n", F.min("w")).alias("m"), F.count("*").alias("edges")), name)
        large = with_lowest(e.select(F.col("v").alias("n"), F.col("u").alias("w")), low, bar).select(F.col("w").alias("n"), F.col("m").alias("w")).distinct()
        # Small star: a node and its lower neighbours hang on the smallest of them.
        large = settled(large, name)
        least = settled(large.groupBy("n").agg(F.min("w").alias("m"), F.count("*").alias("edges")), name)
        small = with_lowest(large, least, bar).select(F.when(F.col("w") == F.col("m"), F.col("n")).otherwise(F.col("w")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = settled(small, name)
        after = _totals(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    found = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
