"""Connected components by min labels, hooking and pointer jumping on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for each node of ``links (a, b)``; label is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours, hands it to its own root, and follows its label
    one step. Minima combine before the shuffle, so a hub costs no more than its links; rounds grow with the logarithm
    of a component's width. Each round's labels are a table in the shared folder.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").filter("a <> b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        told = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("least"))
        told = told.join(labels, told.a == labels.node).select("node", "label", "least")
        mine = F.struct(F.col("node").alias("node"), F.least("label", "least").alias("label"))
        root = F.struct(F.col("label").alias("node"), F.col("least").alias("label"))
        lower = told.select(F.explode(F.array(mine, root)).alias("x")).groupBy("x.node").agg(F.min("x.label").alias("label"))
        lower = written(lower, "lower")
        step = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(lower.join(step, "label").select("node", F.least("label", "next").alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        forget(lower)
        forget(labels)
        labels = after
        if not changed:
            forget(both)
            return labels
