"""N-gram Jaccard join by chosen paths.

Texts are sets of word shingles, embedded as minhash signatures whose entries are samples of
shared tokens. A run starts with all sets in one bucket and splits buckets recursively: the
path of a bucket chooses 1/threshold signature positions on average, and a set moves on to
one child for each, named by its token there. Buckets that are small, or that a split hardly
divides, are compared by brute force. Independent runs repeat until the target recall: how many
a set needs follows from the depth that its own paths reached.

What runs propose is verified on the full shingle sets, tile by tile inside each group of
proposed links; verified links are counted for each text and never listed pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .components import connected_components
from .runs import by_group, complete_groups, local_components, tiled
from .session import cut, text_or_empty
from .textscan import SPACES, mix, scan, shingles
from .totals import with_totals

_CLASS_FIELDS = [StructField("_id", LongType()), StructField("h1", LongType()), StructField("h2", LongType()), StructField("n", IntegerType())]

#: Runs that all sets take part in; sets whose paths go deep take part in further ones.
RUNS = 8


def runs_needed(depth: int, threshold: float, recall: float, tokens: int) -> int:
    """Runs that find a pair at the threshold with probability `recall` when its buckets stop after `depth` steps.

    A pair agrees in a share of its `tokens` positions that chance decides once for all runs. Of
    that share's powers, a step keeps a pair that follows one or two children.
    """
    k = np.arange(tokens + 1)
    weight = np.array([math.comb(tokens, int(i)) for i in k]) * threshold**k * (1 - threshold) ** (tokens - k)
    together, extra = np.ones(tokens + 1), 1 / threshold - 1
    for _ in range(depth):
        x = k / tokens * together
        together = (1 - extra) * x + extra * (1 - (1 - x) ** 2)
    runs, apart = 1, 1 - together
    while weight @ apart**runs > 1 - recall:
        runs += 1
    return runs


def _minhashes(values: np.ndarray, at: np.ndarray, tokens: int) -> np.ndarray:
    """Signature of each text; the positions' hash functions are fixed."""
    n = len(at) - 1
    out = np.zeros((n, tokens), dtype=np.int32)
    some = np.flatnonzero(np.diff(at) > 0)
    if not len(some):
        return out
    odd = np.random.default_rng(7).integers(1, 1 << 63, size=tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(tokens):
        low = ((values * odd[k]) >> np.uint64(32)).astype(np.uint32)
        out[some, k] = np.minimum.reduceat(low, at[some]).view(np.int32)
    return out


def _set_hashes(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each text's shingles, which tell its set from others."""
    out = []
    for v in (values, mix(values)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, width: int, tokens: int) -> DataFrame:
    """doc_id, h1, h2 (of the whole shingle set), n (its size) and sig of each row with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in scan(b.column(1), SPACES):
                values, at = _sets(*shingles(s.hashes(), s.first, width))
                sig = _minhashes(values, at, tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(s.lo, s.n),
                        *map(pa.array, _set_hashes(values, at)),
                        pa.array(np.diff(at).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1, dtype=np.int32) * tokens), pa.array(sig.ravel())),
                    ],
                    names=["doc_id", "h1", "h2", "n", "sig"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint, n int, sig array<int>")


def _sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles sorted and without repeats."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(d[keep], minlength=n))])


def chosen_paths(
    classes: DataFrame, runs: range, threshold: float, tokens: int, small: int, dense: float, most_levels: int, deep: int
) -> tuple[DataFrame, DataFrame | None]:
    """(path, size, id) of the buckets to compare, from classes (id, sig), and (id, depth) of the sets that took `deep` steps or more, if any."""
    extra = 1 / threshold - 1
    sig = classes.select("id", "sig")

    def children(frontier: DataFrame) -> DataFrame:
        second = F.pmod(F.xxhash64("path", F.lit(-1)), F.lit(1_000_000)) < F.lit(int(extra * 1_000_000))
        which = F.explode(F.when(second, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        place = F.pmod(F.xxhash64("path", "child"), F.lit(tokens)).cast("int")
        stepped = frontier.withColumn("child", which).withColumn("place", place)
        return stepped.select(
            "id", F.col("size").alias("parent"), F.xxhash64("path", "child", "place", F.get("sig", F.col("place"))).alias("path")
        )

    def counted(keys: DataFrame) -> DataFrame:
        return with_totals(keys, ["path"], "id", [F.count("*").alias("size")], "size > 1", parts=16)

    start = sig.withColumn("run", F.explode(F.sequence(F.lit(runs[0]), F.lit(runs[-1]))))
    keys = children(start.select("id", "sig", F.xxhash64("run").alias("path"), F.lit(None).cast("long").alias("size")))
    done = deeper = None
    for level in range(most_levels):
        buckets = cut(counted(keys))
        stop = (F.col("size") <= small) | F.coalesce(F.col("size") > dense * F.col("parent"), F.lit(False))
        if level == most_levels - 1:
            stop = F.lit(True)
        ready = buckets.where(stop).select("path", "size", "id")
        done = ready if done is None else done.unionAll(ready)
        rest = buckets.where(~stop).select("id", "path", "size")
        if rest.isEmpty():
            break
        if level + 2 >= deep:
            went = rest.select("id", F.lit(level + 2).alias("depth"))
            deeper = went if deeper is None else deeper.unionAll(went)
        keys = children(rest.join(sig, "id"))
    return done, deeper and deeper.groupBy("id").agg(F.max("depth").alias("depth"))


def run_until(
    classes: DataFrame, threshold: float, tokens: int, recall: float, small: int, dense: float, most_levels: int,
    near: float, chunk: int,
) -> DataFrame:
    """Proposed edges (a, b) of as many runs as each of the classes (id, sig) needs.

    A pair's buckets stop where its sets' do, so the deeper of a set's paths bounds the chance of
    all its links. A link is found once either of its sets has had enough runs.
    """
    needed = {d: runs_needed(d, threshold, recall, tokens) for d in range(1, most_levels + 1)}
    active, done, edges, known = classes, 0, None, None
    runs = max(RUNS, needed[1])
    while True:
        deep = min((d for d, n in needed.items() if n > done + runs), default=most_levels + 1)
        buckets, depths = chosen_paths(active, range(done + 1, done + runs + 1), threshold, tokens, small, dense, most_levels, deep)
        found = proposed_links(buckets, active, tokens, near, chunk)
        edges = found if edges is None else cut(edges).unionAll(found)
        done += runs
        if depths is not None:
            known = depths if known is None else known.unionAll(depths).groupBy("id").agg(F.max("depth").alias("depth"))
        if known is None:
            return edges
        known = cut(known.where(F.col("depth") >= deep))
        deepest = known.agg(F.max("depth")).first()[0]
        if deepest is None:
            return edges
        active = cut(classes.join(known.select("id"), "id", "left_semi"))
        runs = min(RUNS, needed[deepest] - done)


def proposed_links(buckets: DataFrame, classes: DataFrame, tokens: int, near: float, chunk: int) -> DataFrame:
    """Edges (a, b) that join what is alike by signature inside the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in complete_groups(batches, ["path", "_lo", "_hi"]):
            ids = table["id"].to_numpy()
            sig = np.concatenate([c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in table["sig"].chunks])
            sig = sig.reshape(-1, tokens)
            a, b = [], []
            for lo, hi in zip(at[:-1], at[1:]):
                own, x = ids[lo:hi], sig[lo:hi]
                alike = np.zeros((hi - lo, hi - lo), dtype=np.int16)
                for k in range(tokens):
                    alike += x[:, k, None] == x[None, :, k]
                label = local_components(alike >= near * tokens)
                moved = label != np.arange(hi - lo)
                a.append(own[moved])
                b.append(own[label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    rows = tiled(buckets, "path", F.col("size"), "id", chunk).join(classes.select("id", "sig"), "id")
    return by_group(rows.select("path", "_lo", "_hi", "id", "sig"), "path", "_lo", "_hi").mapInArrow(
        run, "a bigint, b bigint"
    ).distinct()


def _shared(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sizes of pairwise intersections of n sets, from their elements and owners, by blocks of elements."""
    out = np.zeros((n, n), dtype=np.float32)
    _, element, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times[element] > 1
    element, row = np.unique(element[often], return_inverse=True)[1], row[often]
    order = np.argsort(element, kind="stable")
    element, row = element[order], row[order]
    step = max(256, (1 << 22) // max(n, 1))
    for lo in range(0, int(element[-1]) + 1 if len(element) else 0, step):
        i, j = np.searchsorted(element, [lo, lo + step])
        block = np.zeros((n, step), dtype=np.float32)
        block[row[i:j], element[i:j] - lo] = 1
        out += block @ block.T
    return out


def verified_links(members: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """(a, b, n): for each member and tile its number of verified links and a verified way to another member (or itself).

    members: id, component, size, shingles (sorted 64-bit values as bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in complete_groups(batches, ["component", "_lo", "_hi"]):
            ids, side = table["id"].to_numpy(), table["_side"].to_numpy()
            diagonal = table["_lo"].to_numpy() == table["_hi"].to_numpy()
            degree, target = np.zeros(len(ids), dtype=np.int64), ids.copy()
            for lo, hi in zip(at[:-1], at[1:]):
                sets = [np.frombuffer(x, dtype=np.uint64) for x in table["shingles"].slice(lo, hi - lo).to_pylist()]
                size = np.array([len(x) for x in sets])
                shared = _shared(np.concatenate(sets), np.repeat(np.arange(hi - lo), size), hi - lo).astype(np.float64)
                linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
                linked &= size[:, None] > 0
                if not diagonal[lo]:
                    s = side[lo:hi]
                    linked &= s[:, None] != s[None, :]
                np.fill_diagonal(linked, False)
                degree[lo:hi] = linked.sum(axis=1)
                target[lo:hi] = ids[lo:hi][local_components(linked)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(target), pa.array(degree)], names=["a", "b", "n"])

    tiles = tiled(members, "component", F.col("size"), "id", chunk)
    return by_group(tiles, "component", "_lo", "_hi").mapInArrow(run, "a bigint, b bigint, n bigint")


def _shingle_bytes(docs: DataFrame, width: int) -> DataFrame:
    """docs (id, component, size, h1, h2, text) with the shingle set for the text, of the rows whose set has these hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in scan(b.column("text"), SPACES):
                values, at = _sets(*shingles(s.hashes(), s.first, width))
                own = b.slice(s.lo, s.n)
                same = np.ones(s.n, dtype=bool)
                for name, h in zip(("h1", "h2"), _set_hashes(values, at)):
                    same &= own.column(name).to_numpy() == h
                sets = pa.array([values[at[i] : at[i + 1]].tobytes() for i in np.flatnonzero(same)], pa.binary())
                own = own.filter(pa.array(same))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in ("id", "component", "size")), sets], names=["id", "component", "size", "shingles"]
                )

    return docs.mapInArrow(run, "id bigint, component bigint, size bigint, shingles binary")


def _joined(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, tokens: int = 64, recall: float = 0.99,
    small: int = 64, dense: float = 0.6, most_levels: int = 24, near: float = 0.6, chunk: int = 512,
) -> tuple[DataFrame, bool]:
    """Rows of the join with the hashes of their sets and `first`, whether their class is the one of its
    component that stays; and whether a doc_id repeats.

    A class is known by the hashes of its set and has an id of its own, so that one doc_id with
    several texts is in several classes.
    """
    sigs = cut(signatures(docs, width, tokens))
    repeats = not sigs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()
    of_class = sigs.groupBy("h1", "h2", "n").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.min("sig").alias("sig")
    )
    classes = cut(of_class.withColumn("id", F.monotonically_increasing_id()))
    full = classes.where("n > 0").select("id", "sig")
    proposed = connected_components(run_until(full, threshold, tokens, recall, small, dense, most_levels, near, chunk))
    proposed = cut(proposed.select(F.col("vertex").alias("id"), "component"))
    sized = with_totals(proposed, ["component"], "id", [F.count("*").alias("size")])
    wanted = sized.join(classes.select("id", F.col("class_id").alias("_doc"), "h1", "h2"), "id")
    texts = docs.select(docs["doc_id"].cast("long").alias("_doc"), text_or_empty(docs).alias("text"))
    sets = _shingle_bytes(texts.join(wanted, "_doc").select("id", "component", "size", "h1", "h2", "text"), width)
    links = cut(verified_links(sets.dropDuplicates(["id"]) if repeats else sets, threshold, chunk))
    component = connected_components(links.select("a", "b")).select(F.col("vertex").alias("id"), "component")
    own = F.struct("class_id", "h1", "h2")
    least = with_totals(
        component.join(classes.select("id", "class_id", "h1", "h2"), "id").select("id", "component", own.alias("own")),
        ["component"], "id", [F.min("own").alias("least")],
    ).select("id", "least")
    degrees = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    per_class = classes.join(least, "id", "left").join(degrees, "id", "left").select(
        "h1", "h2", "n", "class_id", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least.class_id", "class_id").alias("component_id"), F.coalesce(F.col("least") == own, F.lit(True)).alias("first"),
    )
    return sigs.select("doc_id", "h1", "h2", "n").join(per_class, ["h1", "h2", "n"]), repeats


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, copies, n_links, component_id, kept of every row of docs (doc_id, text).

    Words are runs without white space, ASCII letters lower-cased; a text of fewer than
    `width` words has one shingle of all of them. class_id: the least doc_id with the same
    shingle set; copies: the rows of that class; n_links: other classes with Jaccard
    similarity of at least the threshold; component_id: the least doc_id reachable by links;
    kept: doc_id is component_id. Null and empty texts have no shingles: they are one class
    without links. A null doc_id has null ids, no links, and is kept. Where a doc_id repeats, each
    of its rows is in the class of its own text. No rows give no rows.
    """
    known, _ = _joined(docs, **options)
    known = known.select("doc_id", "class_id", "copies", "n_links", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nameless = docs.where("doc_id is null").select(
        F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(1).cast("long"), F.lit(0).cast("long"),
        F.lit(None).cast("long"), F.lit(True),
    )
    return known.unionAll(nameless)


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of linked or equal texts: of its least doc_id, and of that id's texts there the one of least hashes.

    Null and empty texts are one group; rows without doc_id stay; an empty table gives no rows.
    All columns are kept, whatever their names.
    """
    known, repeats = _joined(docs, **options)
    kept = known.where("first and doc_id = class_id").select(F.col("doc_id").alias("_id"), "h1", "h2", "n").distinct()
    named = docs.where("doc_id is not null")
    if not repeats:
        rows = named.join(kept.select("_id"), named["doc_id"].cast("long") == kept["_id"], "left_semi")
        return rows.unionByName(docs.where("doc_id is null"))
    # a doc_id with several texts: its rows are told apart by their sets
    width = options.get("width", 5)
    whole = named.select(named["doc_id"].cast("long").alias("_id"), text_or_empty(named).alias("_text"), F.struct(*[named[c] for c in docs.columns]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in scan(b.column(1), SPACES):
                values, at = _sets(*shingles(s.hashes(), s.first, width))
                hashes = [*map(pa.array, _set_hashes(values, at)), pa.array(np.diff(at).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.n), *hashes, b.column(2).slice(s.lo, s.n)], names=["_id", "h1", "h2", "n", "_row"])

    row = StructType([*_CLASS_FIELDS, whole.schema["_row"]])
    marked = whole.mapInArrow(run, row)
    rows = marked.join(kept, ["_id", "h1", "h2", "n"], "left_semi").dropDuplicates(["_id", "h1", "h2", "n"]).select("_row.*")
    return rows.unionByName(docs.where("doc_id is null"))
