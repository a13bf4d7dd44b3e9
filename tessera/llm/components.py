"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root) for every node that has a link.

    Each round hooks every node to its smallest neighbour, follows these hooks
    to their ends by doubling, and replaces the nodes by the ends. Every
    component at least halves its node count a round. root is one of the
    component's nodes, the same for all of it. Self links and repeated links do
    no harm. Both the hook and the relabelling aggregate before they shuffle, so
    a node with very many links is not gathered.
    """
    edges = stage(edges.select("a", "b").where("a <> b").distinct())
    mapping = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stage(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up")))
        while True:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stage(hook.join(above, "up").select("node", "up", "top"))
            moved = not jumped.where("up <> top").isEmpty()
            hook = jumped.select("node", F.col("top").alias("up"))
            if not moved:
                break
        to_a = hook.select(F.col("node").alias("a"), F.col("up").alias("x"))
        to_b = hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = stage(edges.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if mapping is None:
            mapping = hook.select("node", F.col("up").alias("root"))
        else:
            step = hook.select(F.col("node").alias("root"), "up")
            mapping = stage(mapping.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping
