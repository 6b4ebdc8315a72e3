"""Runs of equal keys in Arrow batches, local components, and tiles of large groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of complete groups handed on together.
BATCH_ROWS = 4096


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the bounds of the groups in them, from rows sorted by the (integer) keys.

    Rows must have been partitioned by the keys. A group is kept together however batches cut it.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
        for k in keys:
            v = t[k].to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < BATCH_ROWS:
            continue
        table = pa.Table.from_batches(held)
        at = bounds(table)
        if len(at) > 2:
            yield table.slice(0, at[-2]), at[:-1]
            table = table.slice(at[-2])
        held, rows = table.to_batches(), 0  # a group longer than a batch is looked at again only when as much has come
    if held:
        table = pa.Table.from_batches(held)
        yield table, bounds(table)


def local_components(linked: np.ndarray) -> np.ndarray:
    """The least index reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    some = np.flatnonzero(linked.sum(axis=1) > linked.diagonal())  # rows with a link to another
    if not len(some):
        return label
    linked = linked[np.ix_(some, some)] | np.eye(len(some), dtype=bool)
    own = np.arange(len(some))
    while True:
        new = np.where(linked, own[None, :], len(some)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == own).all():
            break
        own = new
    label[some] = some[own]
    return label


def tiled(members: DataFrame, group: str, size: Column, row_id: str, chunk: int) -> DataFrame:
    """members once for each tile they take part in, with columns _lo, _hi and _side.

    A group of `size` rows is dealt into ceil(size / chunk) parts by a hash of row_id; a tile
    is a pair of parts, so every pair of rows meets in just one tile (or in the one of its
    own part) and no tile outgrows about two parts. _side: 0 for a row of part _lo, 1 of _hi.
    """
    parts = F.ceil(size / F.lit(chunk)).cast("int")
    part = F.pmod(F.xxhash64(row_id, F.lit(17)), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return (
        members.withColumn("_parts", parts)
        .withColumn("_part", part)
        .withColumn("_other", other)
        .withColumns(
            {
                "_lo": F.least("_part", "_other"),
                "_hi": F.greatest("_part", "_other"),
                "_side": (F.col("_part") > F.col("_other")).cast("int"),
            }
        )
        .drop("_parts", "_part", "_other")
    )


def by_group(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by the keys and sorted by them, for complete_groups."""
    return df.repartition(*keys).sortWithinPartitions(*keys)
