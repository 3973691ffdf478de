"""References as edges: dereferencing, closures, renumbering, structural comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges_of(nodes: DataFrame) -> DataFrame:
    """(file_id, src, dst, key): every reference of an object; those in stream dictionaries are not traced."""
    inside = nodes.where("kind = 'Stream'").select("file_id", "obj").distinct()
    found = nodes.where("kind = 'Reference'").select("file_id", F.col("obj").alias("src"), F.col("ref_id").alias("dst"), "key")
    return found.join(inside.withColumnRenamed("obj", "src"), ["file_id", "src"], "left_anti")


def dereferenced(rows: DataFrame, ref: str, targets: DataFrame, target: str, required: bool) -> DataFrame:
    """Each row with what its key names; required: rows whose target is missing drop out, else they carry nulls."""
    named = targets.withColumnRenamed(target, ref)
    return rows.join(named, ref, "inner" if required else "left")


def closure(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", limit: int = 100, persist=None) -> DataFrame:
    """(root, node, depth): everything reachable from each root with its least depth; cycles end where nothing is new.

    A loop of joins over DataFrames: each round joins only what the last one found, so rows are never counted by path.
    `persist` cuts the lineage of a round (checkpoint by default where the session has a folder for it).
    """
    cut = persist or (lambda df: df)
    seen = cut(roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).alias("depth")))
    front, depth = seen, 0
    while depth < limit:
        depth += 1
        step = front.join(edges, front.node == edges[src]).select("root", F.col(dst).alias("node")).distinct()
        front = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    return seen


def renumbered(keys: DataFrame, group: list[str], key: str, start: Column | int) -> DataFrame:
    """A dense new number for each key of a group, from `start` on in key order."""
    over = Window.partitionBy(*group).orderBy(key)
    return keys.select(*group, key).distinct().withColumn("new_id", (F.row_number().over(over) - 1 + (start if isinstance(start, Column) else F.lit(start))).cast("long"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that only one side has, or whose values differ; nulls are equal to each other."""
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, keys, "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both").alias("side"))


def equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether both have the same rows, repeats counted."""
    return left.exceptAll(right).union(right.exceptAll(left)).agg((F.count("*") == 0).alias("equal"))
