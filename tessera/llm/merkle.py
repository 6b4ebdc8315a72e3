"""A Merkle manifest of a dataset: a digest for each row, one root for all, and for each row the proof that it is under the root.

Each group (a language) has a tree over its rows in order; the groups' roots are the leaves of
one more tree. Trees are dealt out as aligned blocks of a bounded number of leaves: blocks
give their roots, the roots are cut into blocks again, and so on, a few short rounds for any
number of rows. On the way back each block emits the authentication paths of its leaves by
fractal traversal and appends the proof of its own root, which came from the round above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_position
from .session import cut
from .totals import with_totals

#: A block has 2 to this power leaves.
BLOCK_HEIGHT = 8
#: Levels of a stacked subtree.
SUBTREE_HEIGHT = 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PROOF = "path array<string>, subroot string, root string"


def parent(left: str, right: str) -> str:
    """The node over two, over one (the other empty) or over none: digests as hex text."""
    return hashlib.sha256((left + right).encode()).hexdigest() if left else ""


class Desired:
    """The next subtree of one layer while its leaves come in: a treehash whose stack holds one node of each height.

    Of the nodes below the layer nothing stays once their parent is known; those of the layer are kept.
    """

    def __init__(self, leaf: Callable[[int], str], at: int, bottom: int, top: int):
        self.leaf, self.next, self.end, self.bottom = leaf, at << top, (at + 1) << top, bottom
        self.stack: list[tuple[int, int, str]] = []
        self.kept: dict[tuple[int, int], str] = {}

    def step(self) -> None:
        """One unit of work: two nodes of equal height on the stack become one, else a leaf comes in."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (height, _, right), (_, i, left) = stack.pop(), stack.pop()
            node = (height + 1, i >> 1, parent(left, right))
        elif self.next < self.end:
            node = (0, self.next, self.leaf(self.next))
            self.next += 1
        else:
            return
        stack.append(node)
        if node[0] >= self.bottom:
            self.kept[node[:2]] = node[2]

    def finish(self) -> dict[tuple[int, int], str]:
        while self.next < self.end or len(self.stack) > 1:
            self.step()
        return self.kept


def fractal_paths(leaf: Callable[[int], str], leaves: int, height: int, subtree: int = SUBTREE_HEIGHT) -> Iterator[list[str]]:
    """The siblings of each leaf from 0 on, bottom up, with their side: `L` or `R` and the digest, or empty for a lone node.

    Layers of `subtree` levels each: `existing` has the subtree above the current leaf, `desired`
    the one that the layer needs next, which gets two units of work for each leaf that passes and
    so is ready in time. Held at once: two subtrees and a short stack for each layer, whatever the height.
    leaf(i) is empty from `leaves` on: a tree that isn't full has no nodes there.
    """
    at = lambda i: leaf(i) if i < leaves else ""
    layers = [(b, min(b + subtree, height)) for b in range(0, height, subtree)]
    existing = [Desired(at, 0, bottom, top).finish() for bottom, top in layers]
    ahead = lambda i, k: Desired(at, (i >> layers[k][1]) + 1, *layers[k]) if ((i >> layers[k][1]) + 1) << layers[k][1] < leaves else None
    desired = [ahead(0, k) for k in range(len(layers))]
    for i in range(leaves):
        path = []
        for k, (bottom, top) in enumerate(layers):
            if i and i & ((1 << top) - 1) == 0:
                existing[k] = desired[k].finish()
                desired[k] = ahead(i, k)
            for level in range(bottom, top):
                other = (i >> level) ^ 1
                digest = existing[k].get((level, other), "")
                path.append(("L" if other < i >> level else "R") + digest if digest else "")
        yield path
        for tree in desired:
            if tree:
                tree.step()
                tree.step()


def block_root(digests: Sequence[str], height: int) -> str:
    """The node `height` levels above a block's first leaf."""
    level = list(digests)
    for _ in range(height):
        level = [parent(level[i], level[i + 1] if i + 1 < len(level) else "") for i in range(0, len(level), 2)]
    return level[0]


def _height(leaves: int, block_height: int) -> int:
    """Levels that a block's tree has: those of its whole group, but no more than the block's."""
    return min(block_height, (leaves - 1).bit_length())


def _roots(block_height: int):
    def run(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("position")
        size = nodes["size"][0].as_py()
        root = block_root(nodes["digest"].to_pylist(), _height(size, block_height))
        return pa.table({
            "group": pa.array([nodes["group"][0].as_py()], pa.string()), "position": pa.array([nodes["_block"][0].as_py()], pa.int64()),
            "digest": pa.array([root]), "size": pa.array([-(-size >> block_height)], pa.int64()),
        })

    return run


def _append(block_height: int, subtree: int, rest: Sequence[str]):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("position")
        digests = nodes["digest"].to_pylist()
        upper, subroot, root = (above[c][0].as_py() for c in ("path", "subroot", "root"))
        height = _height(nodes["size"][0].as_py(), block_height)
        paths = [path + upper for path in fractal_paths(digests.__getitem__, len(digests), height, subtree)]
        n = len(digests)
        made = {"path": pa.array(paths, pa.list_(pa.string())), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n)}
        return pa.table({c: nodes[c] for c in rest} | made)

    return run


def proofs(nodes: DataFrame, most: int, crown: Callable[[DataFrame], DataFrame], block_height: int = BLOCK_HEIGHT, subtree: int = SUBTREE_HEIGHT) -> DataFrame:
    """nodes (group, position, digest, size, ...) with path, subroot and root.

    position: 0 to size - 1 in the group, size the group's, `most` the largest of them. crown:
    gets one row (group, position 0, digest) for each group and returns group, position, path,
    subroot and root. A task holds one block; rounds follow from `most`: five for 2 to the 40th leaves at
    a block height of 8, each over the last one's blocks.
    """
    if most <= 1:
        above = crown(nodes.select("group", "position", "digest"))
        return nodes.join(above, ["group", "position"])
    blocked = nodes.withColumn("_block", F.shiftright("position", block_height))
    roots = cut(blocked.select("group", "position", "digest", "size", "_block").groupBy("group", "_block").applyInArrow(
        _roots(block_height), "group string, position bigint, digest string, size bigint"
    ))
    above = proofs(roots, -(-most >> block_height), crown, block_height, subtree)
    above = above.select("group", F.col("position").alias("_block"), "path", "subroot", "root")
    schema = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in nodes.columns)
    return (
        blocked.groupBy("group", "_block").cogroup(above.groupBy("group", "_block"))
        .applyInArrow(_append(block_height, subtree, nodes.columns), f"{schema}, {_PROOF}")
    )


def encoded(column: Column) -> Column:
    """A value before it is hashed: UTF-8 byte count, colon, value; `-` for null."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    step = lambda node, s: F.sha2(F.when(s == "", node).when(F.substring(s, 1, 1) == "L", F.concat(F.substr(s, F.lit(2)), node)).otherwise(F.concat(node, F.substr(s, F.lit(2)))), 256)  # noqa: E731, E501
    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """One digest of a proof's siblings, in order."""
    digests = F.transform(F.filter(path, lambda s: s != ""), lambda s: F.substr(s, F.lit(2)))
    return F.sha2(F.array_join(digests, ""), 256)


def _as_crown(block_height: int, subtree: int) -> Callable[[DataFrame], DataFrame]:
    """The tree over the groups' roots, in the order of the groups' names."""

    def crown(tops: DataFrame) -> DataFrame:
        placed = with_position(tops.select(F.col("group").alias("name"), F.col("digest").alias("subroot")), "name")
        size = placed.count()
        nodes = placed.select(F.lit("").alias("group"), "position", F.col("subroot").alias("digest"), F.lit(size).cast("long").alias("size"), "name")
        single = lambda df: df.select("group", "position", F.array().cast("array<string>").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))  # noqa: E731, E501
        found = proofs(nodes, size, single, block_height, subtree)
        return found.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("position"), "path", F.col("digest").alias("subroot"), "root")

    return crown


def merkle_manifest(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", order: str = "doc_id", kept: dict[str, Column] | None = None,
    block_height: int = BLOCK_HEIGHT, subtree: int = SUBTREE_HEIGHT,
) -> DataFrame:
    """One row per row of docs: doc_id (the order column), leaf, path, subroot, root and the columns of `kept`.

    leaf: the digest of `columns`. path: the leaf's siblings up to the root of its group and on to
    the root of all, bottom up, each with its side (`L` or `R`), empty where a node is alone. A
    group of one leaf has that leaf as its root, and so has a dataset of one group.
    Groups come in the bytewise order of their names, null first; rows in that of `order`, nulls first,
    then of their leaves, so repeated rows have leaves and proofs of their own and reruns agree.
    Texts are hashed where they are read and not shuffled. An empty table gives no rows; further columns are ignored.
    """
    leaf = leaf_digest(*[docs[c] for c in columns])
    name = F.when(docs[group].isNull(), "").otherwise(F.concat(F.lit("="), docs[group].cast("string")))
    extra = {f"_{i}": c for i, c in enumerate((kept or {}).values())}
    rows = cut(docs.select(name.alias("group"), docs[order].alias("doc_id"), leaf.alias("digest"), *[c.alias(k) for k, c in extra.items()]))
    # a number tells repeated rows apart, so that they are dealt over tasks too
    placed = with_position(rows.withColumn("_row", F.monotonically_increasing_id()), "group", F.col("doc_id").asc_nulls_first(), "digest", *extra, "_row", name="_place")
    totals = [F.min("_place").alias("_first"), F.count("*").alias("size")]
    nodes = cut(
        with_totals(placed, ["group"], "_row", totals)
        .select("group", (F.col("_place") - F.col("_first")).alias("position"), "digest", "size", "doc_id", *extra)
    )
    most = nodes.agg(F.max("size")).first()[0] or 0
    if not most:
        found = nodes.withColumns({"path": F.array().cast("array<string>"), "subroot": F.col("digest"), "root": F.col("digest")})
    else:
        found = proofs(nodes, most, _as_crown(block_height, subtree), block_height, subtree)
    return found.select("doc_id", F.col("digest").alias("leaf"), "path", "subroot", "root", *[F.col(k).alias(n) for k, n in zip(extra, kept or {})])


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The contract's rows: each row's proof, and whether it still leads to the root after every seventh row, by crc32 of its id, gained a character in n_chars.

    A row without an id is never tampered with.
    """
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = [docs[c] + 1 if c == "n_chars" else docs[c] for c in COLUMNS]
    claim = F.when(hit, leaf_digest(*changed))
    root = folded(F.coalesce("_claim", "leaf"), F.col("path"))
    return (
        merkle_manifest(docs, kept={"_claim": claim})
        .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
