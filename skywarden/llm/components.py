"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skywarden.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable.

    Each round gives a node the smallest label among itself and its neighbours, then follows labels of labels, until nothing
    changes. Rounds are written tables, so no lineage grows; minima are pre-aggregated, so a node with very many
    neighbours is one row from each task. An empty table gives an empty result.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        seen = edges.join(labels, edges.b == labels.node).select(F.col("a").alias("node"), "component")
        least = seen.unionByName(labels).groupBy("node").agg(F.min("component").alias("near"))
        parent = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = written(least.join(parent, "near", "left")
                      .select("node", F.least("near", "far").alias("component")), "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old")
        if changed.isEmpty():
            return new
        labels = new
