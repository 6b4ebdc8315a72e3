"""Scans along an order inside groups, in two levels: a group may hold all rows.

Rows are dealt out by ranges of group and order. Each part is scanned by itself, and what it
hands on, one short row for each group and part, is scanned over the parts of the group. So no
task gets more than a part, however many rows a group has; ties of group and order should be broken by a further column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def dealt(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with _part, the range of group and order that each is in; parts rise with the order."""
    keys = [group, *order]
    return materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))


def _meet(placed: DataFrame, carries: DataFrame, group: str) -> DataFrame:
    """placed with what the other parts of the group hand on; a null group is a group. carries: (group, _part, ...)."""
    told = carries.withColumnsRenamed({group: "_g", "_part": "_p"})
    return placed.join(told, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).drop("_g", "_p", "_part")


def fill(rows: DataFrame, group: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the last value that isn't null at or before each in its group; none before the first."""
    placed = dealt(rows, group, order)
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(value).isNotNull()
    parts = placed.groupBy(group, "_part").agg(F.max_by(value, F.when(known, F.struct(*order))).alias("_last"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = parts.select(group, "_part", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    local = placed.withColumn(name, F.last(value, ignorenulls=True).over(inside))
    return _meet(local, carries, group).withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def following(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """rows with the order column of the next row of the group; null for the last."""
    placed = dealt(rows, group, [order])
    parts = placed.groupBy(group, "_part").agg(F.min(order).alias("_first"))
    after = Window.partitionBy(group).orderBy("_part").rowsBetween(1, 1)
    carries = parts.select(group, "_part", F.max("_first").over(after).alias("_carry"))
    local = placed.withColumn(name, F.lead(order).over(Window.partitionBy(group, "_part").orderBy(order)))
    return _meet(local, carries, group).withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def running_sum(rows: DataFrame, group: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of a number over all rows of the group up to and with each."""
    placed = dealt(rows.withColumn("_value", value), group, order)
    parts = placed.groupBy(group, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = parts.select(group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn(name, F.sum("_value").over(inside))
    return _meet(local, carries, group).withColumn(name, F.col(name) + F.col("_carry")).drop("_carry", "_value")
