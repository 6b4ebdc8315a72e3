"""Sharding by bytes: rows of equal texts stay together and the largest shard is as small as their order allows.

Groups of equal texts are atoms in the order of their texts' hashes. The smallest feasible
shard capacity is found by binary search, each candidate checked by filling shards greedily.
The driver searches over cells, ranges of hashes with the sum of their atoms: it bounds the
capacity from both sides, and only cells in which a cut could fall are split further, until
every cut lies between atoms. So it holds some thousand cells for any number of atoms, and the
result is that of a search over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import with_position
from .session import cut, text_or_empty
from .totals import with_totals

#: Hex digits of the hash that name a cell at first, and those that each split adds.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Behind every hash.
END = "g"


@dataclass(frozen=True)
class ShardPlan:
    """Which shard each text goes to: groups with a shard of their own, and the hashes at which the others' order is cut."""

    shards: int
    own: tuple[str, ...]
    cuts: tuple[str, ...]
    capacity: int

    def shard(self, key: Column) -> Column:
        """The shard, from 0, of a row with this `key`."""
        at = F.lit(len(self.own))
        if self.cuts:
            at = at + F.size(F.filter(F.array(*map(F.lit, self.cuts)), lambda c: c <= key))
        for i, k in enumerate(self.own):
            at = F.when(key == k, F.lit(i)).otherwise(at)
        return at.cast("int")


class Cells:
    """Ranges of atoms in order: ends are places in bytes, whole cells hold one atom."""

    def __init__(self, names: list[str], sizes: np.ndarray, whole: np.ndarray):
        self.names, self.sizes, self.whole = names, sizes, whole
        self.ends = np.cumsum(sizes)
        self.total = int(self.ends[-1]) if len(sizes) else 0

    def backwards(self) -> Cells:
        return Cells(self.names[::-1], self.sizes[::-1], self.whole[::-1])

    def reach(self, at: int, capacity: int, divide: bool) -> int:
        """The last place where a shard from `at` can end: at the end of a cell, or anywhere in one that can be split if divide."""
        to = min(at + capacity, self.total)
        i = int(np.searchsorted(self.ends, to, side="right"))
        before = int(self.ends[i - 1]) if i else 0
        return to if divide and i < len(self.ends) and not self.whole[i] else max(before, at)

    def filled(self, shards: int, capacity: int, divide: bool) -> list[int]:
        """Where greedily filled shards end."""
        at, out = 0, []
        for _ in range(shards):
            at = self.reach(at, capacity, divide)
            out.append(at)
        return out

    def least(self, shards: int, divide: bool) -> int:
        """The smallest capacity with which the shards hold everything: without divide no less than the least for the atoms, with it no more."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.filled(shards, middle, divide)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def between(self, low: int, high: int) -> set[int]:
        """Cells that can be split and lie in part between two places."""
        first, last = int(np.searchsorted(self.ends, low, side="right")), int(np.searchsorted(self.ends - self.sizes, high, side="left"))
        return {i for i in range(first, last) if not self.whole[i]}

    def open(self, shards: int) -> set[str]:
        """Names of the cells in which a greedy cut could fall, for any capacity that could be the least."""
        floor, roof = self.least(shards, True), self.least(shards, False)
        return {self.names[i] for low, high in zip(self.filled(shards, floor, False), self.filled(shards, roof, True)) for i in self.between(low, high)}

    def balanced(self, shards: int, capacity: int) -> tuple[list[int], set[str]]:
        """Ends of all shards but the last, none above the capacity and each as near to an equal share of what is left as it can be; cells to split first."""
        latest = [self.total - p for p in self.backwards().filled(shards, capacity, False)][::-1]  # what the shards behind can't hold starts before
        at, out, unsure = 0, [], set()
        for j in range(1, shards):
            left = shards - j + 1
            low, high = max(latest[j], at), self.reach(at, capacity, False)
            ideal = at + (self.total - at) // left
            unsure |= self.between(ideal, ideal + 1) if low < ideal < high else set()
            if ideal >= high:
                unsure |= self.between(high, self.reach(at, capacity, True))
            places = np.concatenate([[0], self.ends])
            places = places[(places >= low) & (places <= high)]
            off = np.abs((places - at) * left - (self.total - at))
            at = int(places[int(np.argmin(off))])
            out.append(at)
        return out, {self.names[i] for i in unsure}

    def name_from(self, place: int) -> str:
        """The least hash of what starts at a place."""
        i = int(np.searchsorted(self.ends, place, side="right"))
        return self.names[i] if i < len(self.names) else END


def _cells(groups: DataFrame, names: set[str], digits: int) -> list[tuple[str, int, int]]:
    """(name, size, atoms) of the cells into which the named ones fall."""
    found = []
    for n in sorted({len(x) for x in names}):
        of = sorted(x for x in names if len(x) == n)
        inside = groups.where(F.substring("key", 1, n).isin(of)) if n else groups
        sums = inside.groupBy(F.substring("key", 1, n + digits).alias("name")).agg(F.sum("size").alias("size"), F.count("*").alias("atoms"))
        found += [tuple(r) for r in sums.collect()]
    return found


def plan_shards(groups: DataFrame, shards: int) -> ShardPlan:
    """The plan for atoms (key: 64 hex digits, size: bytes, at least 1).

    Atoms larger than an equal share of what is left get a shard of their own, largest first;
    they number fewer than the shards, and so do the rows that are collected to know them. The
    others are cut in the order of their keys; no way of cutting there has a smaller largest
    shard. Under that capacity cuts are taken as near to equal shares as they can be. Fewer
    atoms than shards leave shards empty; none leave them all.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    total = groups.agg(F.sum("size")).first()[0] or 0
    own, left = [], shards
    for r in groups.orderBy(F.col("size").desc(), "key").limit(shards).collect():
        if left == 1 or r["size"] * left <= total:
            break
        own.append(r["key"])
        total, left = total - r["size"], left - 1
    others = groups.where(~F.col("key").isin(own)) if own else groups
    cells: dict[str, tuple[int, int]] = {}
    names, digits = {""}, FIRST_DIGITS
    while True:
        for x in names:
            cells.pop(x, None)
        cells |= {name: (size, atoms) for name, size, atoms in _cells(others, names, digits)}
        digits, order = MORE_DIGITS, sorted(cells)
        now = Cells(order, np.array([cells[x][0] for x in order], dtype=np.int64), np.array([cells[x][1] == 1 for x in order], dtype=bool))
        if not order:
            return ShardPlan(shards, tuple(own), (), 0)
        names = now.open(left) | now.backwards().open(left)
        if not names:
            capacity = now.least(left, False)
            ends, names = now.balanced(left, capacity)
            if not names:
                return ShardPlan(shards, tuple(own), tuple(now.name_from(p) for p in ends), capacity)


def text_key(text: Column) -> Column:
    """The name and the place in order of a group of equal texts."""
    return F.sha2(text, 256)


def _sized(docs: DataFrame) -> DataFrame:
    text = text_or_empty(docs)
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text_key(text).alias("key"),
    )


def _plan_of(rows: DataFrame, shards: int) -> ShardPlan:
    return plan_shards(cut(rows.groupBy("key").agg(F.sum("size").alias("size"))), shards)


def plan_documents(docs: DataFrame, shards: int = 16) -> ShardPlan:
    """The plan for documents whose groups are their equal texts, as assign_shards has it."""
    return _plan_of(cut(_sized(docs).select("key", "size")), shards)


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, key, shard, slot.

    size: UTF-8 bytes of the text and 1. Rows of equal texts share a shard; a null text counts as
    an empty one. slot: the row's place in its shard, from 0 without a gap, by key and id, nulls
    first; repeated rows have slots of their own, which of two equal rows comes first doesn't show. Texts are read once,
    hashed where they are and not shuffled; further columns are ignored; an empty table gives no rows.
    """
    rows = cut(_sized(docs).withColumn("_row", F.monotonically_increasing_id()))
    plan = _plan_of(rows, shards)
    placed = with_position(rows.withColumn("shard", plan.shard(F.col("key"))), "shard", "key", F.col("doc_id").asc_nulls_first(), "_row", name="_place")
    told = with_totals(placed, ["shard"], "_row", [F.min("_place").alias("_first")])
    return told.select("doc_id", "size", "text_crc32", "key", "shard", (F.col("_place") - F.col("_first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, plan: ShardPlan, tasks: int = 0) -> None:
    """The documents themselves as Parquet in folders shard=0, shard=1, ..., in the order of slots inside each file and over file names.

    Rows are dealt by ranges of shard and key, so a large shard is written by several tasks. tasks: how many; 0: as the session has it.
    """
    if "shard" in docs.columns:
        raise ValueError("docs has a column named shard already")
    key = text_key(text_or_empty(docs))
    order = ["_shard", "_key", F.col("_id").asc_nulls_first()]
    rows = docs.select(F.struct("*").alias("row"), key.alias("_key"), docs["doc_id"].alias("_id")).withColumn("_shard", plan.shard(F.col("_key")))
    dealt = rows.repartitionByRange(tasks, *order) if tasks else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("row.*", F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)


def sharding_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The contract's columns under the law `bytes`."""
    return assign_shards(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
