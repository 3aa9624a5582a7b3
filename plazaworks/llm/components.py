"""Connected components by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaworks.llm.shared import kept_at, release, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable.

    Each round every node takes the smallest label among its neighbours' and
    its own, and then its label's label, until nothing changes: a logarithmic
    number of rounds in the length of usual paths. A node with very many edges
    is pre-aggregated where its edges lie. Null ends and loops link nothing.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        better = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "least").alias("to"))
        better = stored(better, "labels")
        onward = better.select(F.col("node").alias("to"), F.col("to").alias("further"))
        found = stored(better.join(onward, "to", "left").select("node", "was", F.coalesce("further", "to").alias("component")), "labels")
        release(labels, better)
        labels = kept_at(found.select("node", "component"), found._stored_at)
        if found.filter("was <> component").isEmpty():
            release(edges)
            return labels
