"""Connected components by least labels and pointer jumping, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for each node of the undirected ``edges``; the label is the component's least node.

    Each step takes the least label among a node's own and its neighbours', then that label's label. Steps end as soon
    as no label changes; stars take two. Joins on a hot node are split by adaptive execution. Edges with a null end, and
    nodes without an edge, are not in the result.
    """
    pairs = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")
    both = materialize(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("m"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        labels = materialize(step, "labels")
        if labels.filter("label != old").isEmpty():
            return labels.drop("old")
        labels = labels.drop("old")
