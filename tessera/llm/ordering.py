"""Positions in a total order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .session import cut

_IN_PARTITION = (1 << 33) - 1


def with_position(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """df with each row's 0-based place by `order`, materialised in the shared folder.

    Rows are dealt out by range and sorted in their partitions; the partitions' row counts
    (one row each, summed in one small window) turn places in a partition into places overall.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part).agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", F.shiftright("_m", 33))
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_m").bitwiseAND(F.lit(_IN_PARTITION)))
        .drop("_m", "_part", "_offset")
    )
