"""Connected components of a link table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links to ``node, root``: the least node reachable. Nodes without links do not appear.

    A round takes the least label among the neighbours by a partial aggregation, then follows labels twice; the number
    of rounds is about the logarithm of the longest chain. Only the count of changed labels reaches the driver. Each
    round's labels are written to the shared folder and the one before it is removed.
    """
    both = scale.materialise(links.select(F.col("a").alias("s"), F.col("b").alias("d"))
                             .unionByName(links.select(F.col("b").alias("s"), F.col("a").alias("d"))).distinct())
    labels = scale.materialise(both.groupBy(F.col("d").alias("node")).agg(F.min("s").alias("_m"))
                               .select("node", F.least("node", "_m").alias("root")))
    while True:
        near = (both.join(labels, both["s"] == labels["node"]).groupBy("d").agg(F.min("root").alias("_m")))
        step = (labels.join(near, labels["node"] == near["d"])
                .select("node", F.col("root").alias("_old"), F.least("root", "_m").alias("_new")))
        step = scale.materialise(step)
        after = step.select(F.col("node").alias("_n"), F.col("_new").alias("_r"))
        jumped = scale.materialise(step.join(after, step["_new"] == after["_n"])
                                   .select("node", "_old", F.least("_new", "_r").alias("root")))
        changed = jumped.where(F.col("_old") != F.col("root")).limit(1).count()
        scale.discard(labels)
        scale.discard(step)
        labels = jumped.select("node", "root")
        if not changed:
            scale.discard(both)
            return labels
