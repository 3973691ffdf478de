"""Object index operators: version merge, free lists, field widths, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one with the greatest `order`; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*[c for c in rest if c not in order]).alias("_r"))).alias("_m"))
    return got.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in order], F.col("_m._r.*")).select(*rows.columns)


def folded(rows: DataFrame, keys: list[str], rev: str, kind: str, gen: str) -> DataFrame:
    """The merge in which a later applied (older) section overwrites packed entries always and others only by a greater gen.

    Sections apply from rev 0 on. The result has the surviving rev of each key.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(rev).alias("rev"), F.col(kind).alias("kind"), F.col(gen).alias("gen"))))
    merged = F.aggregate(
        F.slice("_s", 2, F.size("_s")), F.col("_s")[0],
        lambda acc, x: F.when(acc["kind"].isin("Raw", "Free") & ~(x["gen"] > acc["gen"]), acc).otherwise(x),
    )
    return rows.groupBy(*keys).agg(steps.alias("_s")).select(*keys, merged["rev"].alias("rev"), merged["kind"].alias("kind"), merged["gen"].alias("gen"))


def free_list(rows: DataFrame, group: list[str], number: str, free: Column) -> DataFrame:
    """Free entries threaded upwards: each names the next greater free number, the greatest names 0."""
    over = Window.partitionBy(*group).orderBy(number)
    return rows.where(free).withColumn("next_free", F.coalesce(F.lead(number).over(over), F.lit(0)))


def byte_width(c: Column) -> Column:
    """Bytes that hold a number; 0 needs none."""
    return F.when(c == 0, 0).otherwise(F.ceil(F.length(F.conv(c.cast("string"), 10, 16)) / 2)).cast("int")


def overlaid(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """delta over base: rows of delta replace those of base with the same keys."""
    return base.join(delta, keys, "left_anti").select(*base.columns).unionByName(delta.select(*base.columns))


def merged(base: DataFrame, delta: DataFrame, keys: list[str], fields: str) -> DataFrame:
    """MERGE of map columns: delta's entries on top of base's; rows of either side alone are kept."""
    b, d = base.select(*keys, F.col(fields).alias("_b")), delta.select(*keys, F.col(fields).alias("_d"))
    both = b.join(d, keys, "full_outer")
    empty = F.create_map().cast(base.schema[fields].dataType)
    lower = F.map_filter(F.coalesce("_b", empty), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("_d", empty)), k))
    return both.select(*keys, F.map_concat(lower, F.coalesce("_d", empty)).alias(fields))


def byte_offsets(rows: DataFrame, group: list[str], order: list[str], size: str, start: int = 0) -> DataFrame:
    """Where each part begins when the parts of a group are written in order."""
    over = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("offset", F.sum(size).over(over) - F.col(size) + start)
