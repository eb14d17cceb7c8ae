"""Connected components by smallest label, for tables of links of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every linked node; label is the smallest node it can reach.

    Each round takes the smallest label among the neighbours and then the label of that label, so paths shrink by
    halves and rounds grow with the logarithm of the longest one. Labels are written to a table in each round,
    which cuts their lineage. The joins have one label row a node, so a node with very many links is split by
    adaptive execution; labels are summed up before they are shuffled. Tables of earlier rounds are removed.

    Null nodes are ignored, repeated links count once, links of a node with itself say nothing, and no links give no rows.
    """
    # links are evaluated once: if each direction came from its own evaluation, a link that the second one gives the
    # other way round would be left with one direction
    there, back = (F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ((a, b), (b, a)))
    both = links.select(F.explode(F.array(there, back)).alias("_l")).select("_l.node", "_l.other")
    both = stored(both.filter("node <> other").distinct(), "links")
    labels = held = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        of_other = labels.select(F.col("node").alias("other"), "label")
        near = both.join(of_other, "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = stored(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower")), "lower")
        jump = lower.select(F.col("node").alias("lower"), F.col("lower").alias("next"))
        found = stored(lower.join(jump, "lower").select("node", "label", F.least("lower", "next").alias("new")), "jumped")
        drop_stored(lower, held)
        labels, held = found.select("node", F.col("new").alias("label")), found
        if found.filter("new <> label").isEmpty():
            drop_stored(both)
            return labels
