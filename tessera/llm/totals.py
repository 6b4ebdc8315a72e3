"""Totals of a key beside each of its rows, however many rows one key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of one key are dealt, at most: one for each bit of a long.
PARTS = 64


def salt(by: Column | str, parts: int = PARTS) -> Column:
    """Which part a row belongs to, by a hash of what tells the rows of a key apart."""
    return F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")


def salts_seen(where: Column, part: Column) -> Column:
    """An aggregate: the parts of the rows where a condition holds, as the bits of a long (null without any)."""
    return F.bit_or(F.when(where, F.call_function("shiftleft", F.lit(1).cast("long"), part)))


def each_salt(seen: Column, parts: int = PARTS) -> Column:
    """One row for each part that was seen."""
    return F.explode(F.filter(F.array(*map(F.lit, range(parts))), lambda i: F.getbit(seen, i) == 1))


def with_totals(rows: DataFrame, keys: Sequence[str], by: Column | str, totals: Sequence[Column], having: str = "true", parts: int = PARTS) -> DataFrame:
    """rows with aggregates over all rows of the same keys; keys whose totals fail `having` go with their rows.

    Totals are summed before they are shuffled. They meet the rows by key and part, and only
    where a part has rows: no task gets more than one part of a key, and there are no more
    copies of totals than rows. Few parts do where keys of one group already differ by run or pass. Keys must not be null.
    """
    salted = rows.withColumn("_salt", salt(by, parts))
    sums = salted.groupBy(*keys).agg(*totals, salts_seen(F.lit(True), F.col("_salt")).alias("_seen")).where(having)
    return salted.join(sums.withColumn("_salt", each_salt(F.col("_seen"), parts)).drop("_seen"), [*keys, "_salt"]).drop("_salt")
