"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. (node, root) for each node of an edge, root the least node of its component.

    Each round takes the least root among neighbours and then the root's root, so paths shrink by powers of two. Both
    steps pre-aggregate before they shuffle; a node with very many neighbours is a group that the first aggregation has reduced.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = cut(hooked.join(up, "root").select("node", F.least("root", "above").alias("root"), "was"))
        if new.where("root < was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
