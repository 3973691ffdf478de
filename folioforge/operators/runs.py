"""Ordered operators: runs of consecutive numbers, running codes, last values, range expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers in each group: first, last, size."""
    place = F.col(number) - F.row_number().over(Window.partitionBy(*group).orderBy(number))
    return rows.withColumn("_i", place).groupBy(*group, "_i").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("size")).drop("_i")


def starts_run(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """Rows that don't follow their predecessor's number: those whose code a writer has to state."""
    over = Window.partitionBy(*group).orderBy(number)
    return rows.withColumn("_p", F.lag(number).over(over)).where(~F.coalesce(F.col("_p") + 1 == F.col(number), F.lit(False))).drop("_p")


def running_codes(rows: DataFrame, group: list[str], order: str, code: Column) -> DataFrame:
    """The code of each item of a Differences list: a number sets the counter, each name takes it and adds one."""
    over = Window.partitionBy(*group).orderBy(order)
    at = rows.withColumn("_set", code)
    at = at.withColumn("_isle", F.sum(F.when(F.col("_set").isNotNull(), 1).otherwise(0)).over(over)).withColumn("_from", F.last("_set", True).over(over))
    names = F.sum(F.when(F.col("_set").isNull(), 1).otherwise(0)).over(Window.partitionBy(*group, "_isle").orderBy(order))
    coded = at.withColumn("_n", names).where(F.col("_set").isNull())
    return coded.withColumn("code", (F.coalesce("_from", F.lit(0)) + F.col("_n") - 1).cast("long")).drop("_set", "_isle", "_from", "_n")


def last_before(value: Column, group: list[str], order: list[str]) -> Column:
    """The last value before a row that is not null: the current point of a curve, the current font of a string."""
    return F.last(value, True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def expanded(rows: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """A row for each number of an inclusive range, so that range lookups become equi-joins."""
    return rows.where(F.col(low) <= F.col(high)).withColumn(name, F.explode(F.sequence(low, high))).drop(low, high)


def nesting(step: Column, group: list[str], order: list[str]) -> Column:
    """The depth after each row of what opens (1) and closes (-1)."""
    return F.sum(step).over(Window.partitionBy(*group).orderBy(*order)).cast("long")
