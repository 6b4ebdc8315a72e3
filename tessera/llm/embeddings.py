"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors lexicographically by concatenated random hyperplane bits and
compares every vector with a bounded window of those before it. Verified links of all passes
are united to components. Windows miss links where many vectors crowd, so bucket passes follow:
vectors of equal leading bits are compared without a bound, and the number of passes follows from
the number of bits and the target recall. Bits are chosen by the measured sizes of buckets, so
crowding costs time and not links. Links inside a component are then counted exactly, tile by
tile, without listing pairs.

Vectors travel as the bytes they came in; cosines are taken in double precision. Sorted passes
ship half-precision copies, which can only prove links that are clear of the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runs import by_group, complete_groups, local_components, tiled
from .session import cut
from .textscan import mix
from .totals import with_totals

_BITS = 62

#: Numbers of leading bits that bucket passes may use, and passes that measure the buckets' sizes.
_DEPTHS, _PROBES = range(0, 41, 2), 2

#: Cost of a row in a tile and of a row's key, in compared pairs.
_ROW_COST, _KEY_COST = 1000, 100


#: How far the cosine of half-precision copies of unit vectors can be from that of the vectors.
_HALF_ERROR = 2e-3


def comparable(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, unit: its components' bytes) of the vectors that can be compared, and the components' numpy type."""
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            values = column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)  # a null component is NaN
            start, size = column.offsets.to_numpy()[:-1], np.diff(column.offsets.to_numpy())
            size = np.where(column.is_valid().to_numpy(zero_copy_only=False), size, 0)
            for n in np.unique(size[size > 0]):
                at = np.flatnonzero(size == n)
                x = values[start[at][:, None] + np.arange(n)]
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, x = at[good], np.ascontiguousarray(x[good])
                if len(at):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), _binary(x)], names=["vec_id", "unit"])

    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>"))
    return rows.mapInArrow(run, "vec_id bigint, unit binary"), kind


def _binary(x: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    offsets = (np.arange(len(x) + 1) * x.shape[1] * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column, kind: str) -> np.ndarray:
    """Rows of bytes, all of one length, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _units(column, kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    x = _matrix(column, kind).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of equal length; vectors of different lengths never meet."""
    size = pa.compute.binary_length(b.column("unit")).to_numpy(zero_copy_only=False)
    for length in np.unique(size):
        yield int(length), b.filter(pa.array(size == length))


def _keys(x: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """For each vector and pass, the bits of random projections, the first the most significant."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], passes * _BITS))
    bits = (x @ planes >= 0).reshape(len(x), passes, _BITS).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(_BITS - 1, -1, -1, dtype=np.int64))


def candidate_links(rows: DataFrame, threshold: float, passes: int, window: int, seed: int, kind: str = "<f8") -> DataFrame:
    """Edges (a, b) that join what the passes' windows link; every edge's vectors are linked, through others at most."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, part in _by_length(b):
                x = _units(part.column("unit"), kind)
                keys, half = _keys(x, passes, seed + length), _binary(x.astype("<f2"))
                for p in range(passes):
                    # vectors of one length and pass have one group
                    group = pa.array(np.full(part.num_rows, length * passes + p, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([group, pa.array(keys[:, p]), part.column("vec_id"), half], names=["group", "key", "vec_id", "half"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_ids, last_x, last_group = None, None, None
        for b in batches:
            group = b.column("group").to_numpy()
            at = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [b.num_rows]])
            for lo, hi in zip(at[:-1], at[1:]):
                if lo == hi:
                    continue
                ids_all, x_all = b.column("vec_id").to_numpy()[lo:hi], _matrix(b.column("half").slice(lo, hi - lo), "<f2").astype(np.float32)
                for s in range(0, hi - lo, window):
                    ids, x = ids_all[s : s + window], x_all[s : s + window]
                    if last_group == group[lo]:
                        ids, x = np.concatenate([last_ids, ids]), np.concatenate([last_x, x])
                    label = local_components(x @ x.T >= threshold + _HALF_ERROR)
                    moved = label != np.arange(len(label))
                    if moved.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"]
                        )
                    last_ids, last_x, last_group = ids[-window:], x[-window:], group[lo]

    order = ("group", "key", "vec_id")
    spread_out = rows.select("vec_id", "unit").mapInArrow(spread, "group bigint, key bigint, vec_id bigint, half binary")
    return spread_out.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, "a bigint, b bigint").distinct()


def passes_for(depth: int, threshold: float, recall: float) -> int:
    """Passes of buckets of `depth` equal bits that find a link at the threshold with probability `recall`."""
    kept = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** depth
    return 1 if kept >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-kept))


def bucket_keys(rows: DataFrame, depth: int, passes: int, seed: int, kind: str = "<f8") -> DataFrame:
    """turn (one for each length and pass), key (of `depth` bits), vec_id and component of rows (vec_id, unit, component), once per pass."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, part in _by_length(b):
                x = _units(part.column("unit"), kind)
                for p in range(passes):
                    planes = np.random.default_rng([seed, length, p]).standard_normal((x.shape[1], depth))
                    key = (x @ planes >= 0).astype(np.int64) @ (np.int64(1) << np.arange(depth - 1, -1, -1, dtype=np.int64))
                    turn = pa.array(np.full(len(x), length * passes + p, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [turn, pa.array(key), part.column("vec_id"), part.column("component")], names=["turn", "key", "vec_id", "component"]
                    )

    return rows.select("vec_id", "unit", "component").mapInArrow(spread, "turn bigint, key bigint, vec_id bigint, component bigint")


def _sizes() -> list:
    """Size, least and greatest component of a bucket."""
    return [F.count("*").alias("size"), F.min("component").alias("_least"), F.max("component").alias("_most")]


#: A bucket is open if it holds more than one component.
_OPEN = "_least <> _most"


def cheapest_depth(rows: DataFrame, threshold: float, recall: float, chunk: int, seed: int, kind: str = "<f8") -> int:
    """The number of bits whose passes cost least, by the sizes of buckets that a few passes measure."""
    keys = bucket_keys(rows, _DEPTHS[-1], _PROBES, seed, kind).withColumn("depth", F.explode(F.array(*map(F.lit, _DEPTHS))))
    keys = keys.withColumn("key", F.expr(f"shiftright(key, {_DEPTHS[-1]} - depth)"))
    size = F.col("size").cast("double")
    measured = keys.groupBy("turn", "depth", "key").agg(*_sizes()).where(_OPEN).groupBy("depth").agg(
        F.sum(size * F.ceil(size / chunk) * _ROW_COST + size * size).alias("cost")
    )
    cost, n = {r["depth"]: r["cost"] / _PROBES for r in measured.collect()}, rows.count()
    return min(_DEPTHS, key=lambda d: passes_for(d, threshold, recall) * (cost.get(d, 0.0) + n * _KEY_COST))


def bucket_links(rows: DataFrame, threshold: float, depth: int, passes: int, chunk: int, seed: int, kind: str = "<f8") -> DataFrame:
    """Edges (a, b) between components of rows (vec_id, unit, component) that links in the passes' buckets join."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in complete_groups(batches, ["turn", "key", "_lo", "_hi"]):
            ids, component = table["vec_id"].to_numpy(), table["component"].to_numpy()
            side, diagonal = table["_side"].to_numpy(), table["_lo"].to_numpy() == table["_hi"].to_numpy()
            a, b = [ids[:0]], [ids[:0]]
            for lo, hi in zip(at[:-1], at[1:]):
                own, c = ids[lo:hi], component[lo:hi]
                if (c == c[0]).all():
                    continue
                x = _units(table["unit"].slice(lo, hi - lo), kind)
                if diagonal[lo]:
                    linked = x @ x.T >= threshold
                else:
                    left, right = np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1)
                    linked = np.zeros((hi - lo, hi - lo), dtype=bool)
                    linked[np.ix_(left, right)] = x[left] @ x[right].T >= threshold
                    linked |= linked.T
                label = local_components(linked)
                moved = c != c[label]
                a.append(own[moved])
                b.append(own[label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    keys = bucket_keys(rows, depth, passes, seed, kind)
    tiles = tiled(with_totals(keys, ["turn", "key"], "vec_id", _sizes(), _OPEN, parts=16), "key", F.col("size"), "vec_id", chunk)
    tiles = tiles.select("turn", "key", "_lo", "_hi", "_side", "vec_id").join(rows.select("vec_id", "unit", "component"), "vec_id")
    return by_group(tiles, "turn", "key", "_lo", "_hi").mapInArrow(compare, "a bigint, b bigint").distinct()


def count_links(members: DataFrame, threshold: float, chunk: int, kind: str = "<f8") -> DataFrame:
    """(vec_id, n) from members (vec_id, unit, weight, component, size): the weight of those linked to each, in its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in complete_groups(batches, ["component", "_lo", "_hi"]):
            ids, weight = table["vec_id"].to_numpy(), table["weight"].to_numpy()
            side, diagonal = table["_side"].to_numpy(), table["_lo"].to_numpy() == table["_hi"].to_numpy()
            degree = np.zeros(len(ids), dtype=np.int64)
            for lo, hi in zip(at[:-1], at[1:]):
                x, w, s = _units(table["unit"].slice(lo, hi - lo), kind), weight[lo:hi], side[lo:hi]
                linked = x @ x.T >= threshold
                if not diagonal[lo]:
                    linked &= s[:, None] != s[None, :]
                np.fill_diagonal(linked, False)
                degree[lo:hi] = linked @ w
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(degree)], names=["vec_id", "n"])

    tiles = tiled(members, "component", F.col("size"), "vec_id", chunk)
    counted = by_group(tiles, "component", "_lo", "_hi").mapInArrow(run, "vec_id bigint, n bigint")
    return counted.groupBy("vec_id").agg(F.sum("n").alias("n"))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, passes: int = 6, window: int = 256, chunk: int = 1024, seed: int = 1,
    recall: float = 0.9999,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, as do vectors of different lengths. Equal vectors are one class that is compared once
    and counted with its size. Where a vec_id repeats, each of its rows is a vector of its own. A
    null vec_id has no links and component null, and is kept. No rows give no rows.

    Sorted passes connect what their windows bring together. Bucket passes among different
    components then find each link with probability `recall` or more, whatever the number of rows
    and however they crowd, and links need only join components to be counted.
    """
    rows, kind = comparable(vectors)
    # a class of equal vectors has an id of its own, because a vec_id can have several
    of_class = rows.groupBy("unit").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes = cut(of_class.withColumn("vec_id", F.monotonically_increasing_id()))
    edges = candidate_links(classes, threshold, passes, window, seed, kind)
    component = cut(connected_components(edges).select(F.col("vertex").alias("vec_id"), "component"))
    parted = classes.select("vec_id", "unit").join(component, "vec_id", "left")
    parted = cut(parted.select("vec_id", "unit", F.coalesce("component", "vec_id").alias("component")))
    depth = cheapest_depth(parted, threshold, recall, chunk, seed, kind)
    joined = cut(bucket_links(parted, threshold, depth, passes_for(depth, threshold, recall), chunk, seed, kind))
    if not joined.isEmpty():
        edges = component.select(F.col("vec_id").alias("a"), F.col("component").alias("b")).unionAll(joined)
        component = cut(connected_components(edges).select(F.col("vertex").alias("vec_id"), "component"))
    named = component.join(classes.select("vec_id", "first"), "vec_id")
    sized = cut(with_totals(named, ["component"], "vec_id", [F.count("*").alias("size"), F.min("first").alias("least")]))
    members = classes.select("vec_id", "unit", "weight").join(sized.select("vec_id", "component", "size"), "vec_id")
    links = count_links(members, threshold, chunk, kind)
    per_class = classes.join(sized.select("vec_id", "least"), "vec_id", "left").join(links, "vec_id", "left").select(
        "unit", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")
    )
    known = rows.join(per_class, "unit").select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(~F.coalesce(_can_compare(F.col("embedding")) & F.col("vec_id").isNotNull(), F.lit(False)))
    lone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionAll(lone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _can_compare(v: Column) -> Column:
    """What `comparable` keeps: finite components, one of them not zero."""
    x = v.cast("array<double>")
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    return finite & F.exists(x, lambda e: e != 0)
