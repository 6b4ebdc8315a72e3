"""Numbers in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

_IN_PARTITION = (1 << 33) - 1


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their number by `order`, from 1, without a window over all of them.

    Rows are dealt out by range and sorted; the few partitions' counts, summed in one small window,
    turn places in a partition into places overall.
    """
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_m", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.col("_m").bitwiseAND(F.lit(_IN_PARTITION)) + 1
    return placed.join(offsets, "_part").withColumn(name, place).drop("_m", "_part", "_offset")
