"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of (a, b) is connected to.

    Every round takes the least label among the neighbours and then the label of that
    label; both are one row per node in the shuffle, and rounds grow with the logarithm
    of the longest path.  Each round's labels are written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("above"))
        jumped = step.join(up, "next", "left").select("node", F.coalesce("above", "next").alias("label"), (F.coalesce("above", "next") != F.col("label")).alias("changed"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("changed").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
