"""Connected components of an edge list (O60): minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokes.storage import drop_saved, save


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the least node that can be reached, edges taken both ways.

    Every round takes the least label of the neighbours (combined before the
    shuffle) and then the label of the label, so long chains halve; each round is
    a table in the shared folder. Nodes are of any ordered type; rows with a null
    end are ignored; self-loops make a node of its own.
    """
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    both = save(ends.union(ends.select("dst", "src")).distinct(), "edges")
    labels = save(both.groupBy("src").agg(F.min("dst").alias("d")).select(F.col("src").alias("node"), F.least("src", "d").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.node == near.src).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = least.join(of, least.label == of["at"], "left").select("node", "old", F.coalesce(F.least("next", "label"), "label").alias("label"))
        step = save(jumped, "labels")
        drop_saved(labels)
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            drop_saved(both)
            return labels.withColumnRenamed("label", "component")
