"""Connected components over edges that stay distributed.

Alternating large-star and small-star rounds: each round replaces a node's edges by edges to
its smallest neighbour, so a component becomes a star around its smallest node after a number
of rounds that grows with the logarithm of its size. Each round's edges are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (u, v); the root is its component's smallest node.

    Nodes are of any ordered type. Loops, repeated edges and both directions are allowed;
    a node that has none but loops isn't in the result, nor are null nodes.
    """
    edges = checkpointed(edges.where("u <> v").select("u", "v"))
    seen = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = now
        edges = checkpointed(_star(_star(edges, large=True), large=False))
