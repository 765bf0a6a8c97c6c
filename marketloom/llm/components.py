"""Connected components by smallest-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import durable


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """One row (node, component) for each node of the undirected edges; component is the smallest
    node that can be reached.

    Every round takes the smallest label among the neighbours and then the label's own label, so
    chains shorten exponentially. Neighbours are folded before the shuffle and joined on the neighbour, so a
    hub with a third of all edges is split by the skewed join. Edges with a null end are no edges; an edge from a
    node to itself makes a component of one; repeated edges count once; no edges give no rows.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = durable(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        near = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        found = durable(
            near.join(jump, "near").select(
                "node", F.least("near", "far").alias("component"), (F.least("near", "far") != F.col("component")).alias("moved")
            )
        )
        labels = found.drop("moved")
        if found.where("moved").isEmpty():
            return labels
