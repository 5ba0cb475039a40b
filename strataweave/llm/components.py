"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.shared import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); root is the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label of the
    label, so a chain shortens by half a round. Rounds are written to the shared folder, and
    only whether anything changed comes to the driver.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = staged(labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old")), "labels")
        ahead = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = staged(lower.join(ahead, "root").select("node", F.col("next").alias("root"), "old"), "labels")
        labels = jumped.select("node", "root")
        if jumped.filter("root <> old").isEmpty():
            return labels
