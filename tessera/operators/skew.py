"""Joins of many rows with one row for each key, however many rows one key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of one key are dealt, at most.
PARTS = 32


def meet(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: Column | str, parts: int = PARTS) -> DataFrame:
    """rows joined with table, which has each key once: rows of a key are dealt into parts by a hash of `by`.

    A key's row is copied only to the parts that have rows, so there are no more copies than
    rows, and no task gets more than one part of a key. The parts are found by a distinct that is combined before it is shuffled. Null keys meet nothing.
    """
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    seen = salted.select(*keys, "_part").distinct()
    return salted.join(seen.join(table, list(keys)), [*keys, "_part"]).drop("_part")


def with_counts(rows: DataFrame, key: str, by: Column | str, name: str, parts: int = PARTS) -> DataFrame:
    """rows with the number of rows of the same key."""
    return meet(rows, rows.groupBy(key).agg(F.count("*").alias(name)), [key], by, parts)
