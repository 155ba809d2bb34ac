"""Connected components of an edge table, with joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest
    node that can be reached.

    Each round takes the smallest label among the neighbours and then follows
    labels one step, so the distance that a label travels doubles. Rounds are
    written to the shared folder. Minima are combined before the shuffle and
    adaptive execution splits the joins of a hub, which has one row of its own
    on one side. The result lies in `scratch`, if given.
    """
    own = Scratch(edges.sparkSession)
    stored = own.stored

    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("mid")
        )
        ahead = labels.select(F.col("node").alias("mid"), F.col("root").alias("next"))
        new = stored(lower.join(ahead, "mid").select("node", "old", F.least("mid", "next").alias("root")), "labels")
        changed = new.filter(F.col("root") != F.col("old")).limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            own.clear(keep=1)
            if scratch is not None:
                scratch.paths += own.paths
            return labels
