"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import shared as S


def connected(links: DataFrame) -> DataFrame:
    """links: (a long, b long). Returns (node, root), root being the smallest node reachable, for every linked node.

    Each round takes the smallest label among neighbours and then the label's own label, so labels travel ever
    further; rounds are written to the shared folder, and only their count of changes comes to the driver.
    """
    both = S.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = S.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        before, step = labels, S.written(step.join(jump, "root", "left").select("node", "old", F.least("root", "further").alias("root")), "labels")
        done = step.filter("old <> root").isEmpty()
        S.discard(before)
        labels = step.select("node", "root")
        labels.scratch_path = step.scratch_path
        if done:
            S.discard(both)
            return labels
