"""Connected components of an edge table, by smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.runtime import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for all nodes of edges ``(a, b)``; label is the smallest id.

    Every round gives a node the smallest label among its neighbours and then
    the label of that label, so long chains shorten by halves.  Rounds end when
    no label changes.  Each round is stored, so a lost executor costs a reread.
    """
    both = edges.filter("a <> b")
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("label")
        )
    )
    while True:
        heard = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        lowered = labels.join(heard, "node").select(
            "node", "label", F.least("label", "heard").alias("next")
        )
        of = lowered.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        stepped = cut_lineage(
            lowered.join(of, "next").select("node", F.col("jump").alias("label"), F.col("label").alias("was"))
        )
        changed = stepped.filter("label <> was").limit(1).count()
        labels = stepped.select("node", "label")
        if not changed:
            return labels
