"""Connected components of a table of links, without gathering links anywhere.

Each round, every node with a smaller neighbour hooks to the smallest one; the hooks are shortened
to their roots by doubling; then the links are contracted to roots. A node that is not the least of
its neighbourhood is gone after a round, so the rounds grow with the logarithm of a component. All
steps are partially aggregated or joins that Spark can split where a node has many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import store


def components(links: DataFrame, scope: str = "") -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node that it reaches.

    Loops, repeated links and either direction are fine. Nodes without links are not returned.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    edges = store.written(links.select(hi, lo).where("hi > lo").distinct(), "links", scope)
    nodes = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct()
    labels, left = nodes.withColumn("root", F.col("node")), not edges.isEmpty()
    while left:
        hooks = store.written(edges.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks", scope)
        moved = True
        while moved:
            # Two doublings for each table that is written.
            for _ in range(2):
                onward = hooks.select(F.col("hi").alias("lo"), F.col("lo").alias("next"))
                jumped = hooks.join(onward, "lo", "left").select("hi", F.coalesce("next", "lo").alias("lo"), F.col("next").isNotNull().alias("moved"))
                hooks = jumped.select("hi", "lo")
            jumped = store.written(jumped, "hooks", scope)
            hooks, moved = jumped.select("hi", "lo"), not jumped.where("moved").isEmpty()
        labels = labels.join(hooks.select(F.col("hi").alias("root"), F.col("lo").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        a = hooks.select("hi", F.col("lo").alias("a"))
        b = hooks.select(F.col("hi").alias("lo"), F.col("lo").alias("b"))
        drawn = edges.join(a, "hi", "left").join(b, "lo", "left").select(F.coalesce("a", "hi").alias("a"), F.coalesce("b", "lo").alias("b"))
        edges = store.written(drawn.select(hi, lo).where("hi > lo").distinct(), "links", scope)
        left = not edges.isEmpty()
    return labels
