"""Hierarchies: walks in order, inheritance from ancestors, page numbers, name and number trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 16


def walked(nodes: DataFrame, group: list[str], node: str, parent: str, ordinal: str, inherit: list[str] = (), depth: int = MAX_DEPTH) -> DataFrame:
    """Every node with its depth, the ordinals on its way (`path`, sorts in document order) and inherited attributes.

    An attribute that a node lacks comes from the nearest ancestor that has it. Top-down levels: each joins the children
    of the last one, so a level is one join on the parent key; nodes deeper than `depth` are left out.
    """
    own = [F.col(c).alias(f"_own_{c}") for c in inherit]
    kids = nodes.select(*group, F.col(node).alias("_node"), F.col(parent).alias("_parent"), F.col(ordinal).alias("_ord"), *own)
    at = nodes.where(F.col(parent).isNull()).select(*group, F.col(node).alias("_at"), F.lit(0).alias("depth"), F.array(F.col(ordinal).cast("long")).alias("path"), *inherit)
    out = at
    for level in range(1, depth + 1):
        at = at.join(kids, [at[g] == kids[g] for g in group] + [at["_at"] == kids["_parent"]]).select(
            *[at[g] for g in group], F.col("_node").alias("_at"), F.lit(level).alias("depth"), F.concat("path", F.array(F.col("_ord").cast("long"))).alias("path"), *[F.coalesce(f"_own_{c}", at[c]).alias(c) for c in inherit]
        )
        out = out.unionByName(at)
    return out.withColumnRenamed("_at", node)


def numbered(leaves: DataFrame, group: list[str], path: str = "path") -> DataFrame:
    """Leaves in document order, from 0 in each group."""
    return leaves.withColumn("page_no", (F.row_number().over(Window.partitionBy(*group).orderBy(path)) - 1).cast("int"))


def name_tree_levels(entries: DataFrame, group: list[str], key: str, fan: int) -> DataFrame:
    """Leaves of a name tree of `fan` keys: leaf number and limits of each, keys in byte order."""
    placed = entries.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(key)) - 1)
    return placed.groupBy(*group, F.floor(F.col("_rn") / fan).cast("int").alias("leaf")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("keys"))
