"""Connected components on tables: the smallest node that each node can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossarium.llm.common import cut, uncut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b).

    Each round takes the least label among a node's neighbours and then the
    label of that label, so labels travel twice as far with every round. Every
    round is a table of its own; the driver sees one count per round. Rows of
    a hub are many on one side of a join only, which adaptive execution splits.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy("b").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard.withColumnRenamed("b", "node"), "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("near"))
        nearer = cut(nearer, "nearer")
        if not nearer.filter("near < label").limit(1).count():
            uncut(both, nearer)
            return labels
        jump = nearer.select(F.col("node").alias("near"), F.col("near").alias("far"))
        old, labels = labels, cut(nearer.join(jump, "near").select("node", F.least("near", "far").alias("label")), "labels")
        uncut(old, nearer)
