"""Connected components as DataFrames: minimum labels along edges, then pointer jumps, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """(n, c) for every node of edges (a, b): c is the least node of n's component.

    Each round joins edges with checkpointed labels, so a node with very many edges can be split by the join; lineage is
    cut with checkpoint() and only a count comes to the driver.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("c")).checkpoint()
    while True:
        near = both.join(labels, F.col("b") == F.col("n")).groupBy(F.col("a").alias("n")).agg(F.min("c").alias("c"))
        lower = labels.select("n", "c", F.col("c").alias("was")).unionByName(near.withColumn("was", F.lit(None).cast(labels.schema["c"].dataType)))
        lower = lower.groupBy("n").agg(F.min("c").alias("c"), F.max("was").alias("was")).checkpoint()
        jump = lower.select(F.col("n").alias("n2"), F.col("c").alias("c2"))
        new = lower.join(jump, F.col("c") == F.col("n2"), "left").select("n", F.least("c", F.coalesce("c2", "c")).alias("c"), "was").checkpoint()
        changed = not new.where("c <> was").isEmpty()
        labels = new.select("n", "c")
        if not changed:
            return labels
