"""Connected components of a graph of edges, by label propagation with pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import drop_stage, stage


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """node, label for each node of an edge, label being the smallest node of its component.

    Each round sets a node's label to the smallest label around it, then to that label's own label, so that the
    distance to the smallest node shrinks to about half. Tables are written at each round.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    links, links_at = stage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels, at = stage(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = links.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        joined, joined_at = stage(labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("new")), "labels")
        up = joined.select(F.col("u").alias("new"), F.col("new").alias("up"))
        fresh, fresh_at = stage(joined.join(up, "new", "left").select("u", "old", F.least("new", F.coalesce("up", "new")).alias("label")), "labels")
        changed = not fresh.where("old <> label").isEmpty()
        drop_stage(spark, at, joined_at)
        labels, at = fresh.select("u", "label"), fresh_at
        if not changed:
            drop_stage(spark, links_at)
            return labels.select(F.col("u").alias("node"), "label")
