"""Connected components of a distributed list of links, by least label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.llm.common import remove, stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of every node in ``a, b`` links.

    Every node takes the least label among itself and its neighbours, then its label's label; the rounds grow
    with the logarithm of a component's diameter. Only counts reach the driver. Minima are taken before rows are
    dealt, so a hub with many neighbours costs one row for each task. The labels of a round are removed after the next.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component"))
    labels, at = stored(spark, labels, "labels")
    while True:
        offered = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("offer"))
        near = labels.join(offered, labels.node == offered.a, "left").select("node", F.col("component").alias("was"), F.least("component", "offer").alias("component"))
        up = labels.select(F.col("node").alias("at"), F.col("component").alias("above"))
        new = near.join(up, near.component == up["at"], "left").select("node", "was", F.least("component", "above").alias("component"))
        new, next_at = stored(spark, new, "labels")
        remove(spark, at)  # the new labels are a table of their own
        at = next_at
        if not new.filter("component <> was").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
