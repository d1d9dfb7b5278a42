"""Connected components by least labels and pointer jumping, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b); root: the least node of its component.

    Each round a node takes the least root among its own and its neighbours', then the root of
    that root, so chains shorten by half or more; it ends when no root changes. Rounds are
    written to the shared folder. Repeated edges and loops don't matter; no edges give no rows.
    """
    # Both directions from one evaluation: evaluated twice, edges may come the other way round.
    ways = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way"))
    both = stage(ways.select("way.a", "way.b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lowered = labels.join(around, "node").select("node", "root", F.least("root", "near").alias("low"))
        jumped = lowered.join(labels.select(F.col("node").alias("low"), F.col("root").alias("next")), "low")
        labels = stage(jumped.select("node", F.least("low", "next").alias("root"), (F.least("low", "next") != F.col("root")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "root")
