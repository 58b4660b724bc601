"""Connected components of an edge table by min-label propagation with pointer jumping (distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm._spark import write_shared


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label): every node of edges(a, b) with the smallest node that it can reach.

    Nulls link nothing; repeated edges and loops do no harm. Each round takes the smallest label among
    neighbours, then follows labels of labels, so chains shorten by half a round. Lineage is cut by
    tables in the shared folder; rounds stop when no label changes.
    """
    both = write_shared(edges.where("a is not null and b is not null").select("a", "b").unionByName(edges.where("a is not null and b is not null").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_shared(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("label").alias("far"))
        moved = write_shared(hooked.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("far", "now")).alias("label")), "labels")
        changed = moved.where("label <> was").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("connected components did not settle")
