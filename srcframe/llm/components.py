"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from srcframe.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node reachable) for every node of ``links (u, v)``.

    Each round takes the smallest label among the neighbours and then the label of that
    label, so the number of rounds grows with the logarithm of the longest path. Labels
    stay in tables; the driver only sees whether any changed.
    """
    both = stored(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stored(both.groupBy("u").agg(F.min("v").alias("near")).select(
        F.col("u").alias("node"), F.least("u", "near").alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("_near")), "v")
            .groupBy("u").agg(F.min("_near").alias("_near")).withColumnRenamed("u", "node")
        )
        met = labels.join(near, "node").withColumn("next", F.least("label", "_near"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("_jump"))
        moved = stored(met.join(jump, "next").select("node", "label", F.least("next", "_jump").alias("next")))
        changed = moved.where(F.col("label") != F.col("next")).limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
