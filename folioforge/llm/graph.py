"""Connected components over edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over `edges` (a, b); nodes without an edge are not listed.

    Labels take the least of their neighbours', then that label's own label, so chains shorten twice as fast each
    round. Minima are combined before each shuffle, which keeps a node with very many edges cheap; every round is a
    written table, so a lost executor costs one round at most.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "v"))
    last = None
    while True:
        near = both.join(labels, both.a == labels.v).groupBy("b").agg(F.min("l").alias("m")).withColumnRenamed("b", "v")
        step = stored(near.join(labels, "v").select("v", F.least("m", "l").alias("l")))
        top = step.select(F.col("v").alias("l"), F.col("l").alias("t"))
        after = stored(step.join(top, "l").select("v", F.col("t").alias("l")))
        discard(labels, step)
        labels = after
        now = labels.agg(F.sum(F.col("l").cast("decimal(38,0)")), F.count("*")).first()
        if now == last:
            discard(both)
            return labels.select(F.col("v").alias("node"), F.col("l").alias("component"))
        last = now
