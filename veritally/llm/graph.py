"""Connected components of an edge table, as joins and group minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritally.llm.common import staged


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """edges (a, b): node, component (smallest node id it is connected with).

    Each round takes the least label among neighbours, then the label of that label, so long chains
    shrink by doubling. A round's labels are written to the shared folder; the driver sees one count.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        low = labels.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        low = staged(low.join(jump, "component", "left").select("node", F.coalesce(F.least("next", "component"), "component").alias("component"), "was"), name)
        changed = low.where("component <> was").limit(1).count()
        labels = low.select("node", "component")
        if not changed:
            return labels
