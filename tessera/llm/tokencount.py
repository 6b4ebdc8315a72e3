"""Token counts of documents in flat, unindexed token files.

A token file is a bare sequence of little-endian ids in which an end identifier closes each
document. Files are cut into blocks of equal size regardless of documents. Each block is
searched for the identifier with one vectorised comparison; a prefix scan over the blocks'
last separators tells each block where the document open at its start began.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import TokenizerFiles
from .session import cut, text_or_empty

BLOCK_TOKENS = 1 << 16
#: Blocks whose separators are scanned together before their groups are.
GROUP_BLOCKS = 1024
#: Blocks of a file that are read in one range.
READ_BLOCKS = 64


def _store(path: str):
    """The file system of a path or URI and the path in it, as pyarrow has them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _read(data: Callable, at: int, count: int, width: int) -> bytes:
    part = data(count * width, at * width)
    if len(part) != count * width:
        raise OSError(f"{len(part)} bytes where {count * width} were expected")
    return bytes(part)


def read_token_files(spark, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, ids) of the flat files under path, read in byte ranges of READ_BLOCKS blocks.

    Only names and lengths are listed first, so a file of any size is read by as many tasks as
    it has ranges. Executors open the ranges through pyarrow's file systems.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    last = F.floor((F.col("length") - 1) / (width * block_tokens))
    ranges = files.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(READ_BLOCKS).cast("long"))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length, first in zip(*(b.column(i).to_pylist() for i in range(3))):
                if length % width:
                    raise ValueError(f"{name} has {length} bytes, no multiple of {width}")
                system, at = _store(name)
                with system.open_input_file(at) as f:
                    for block in range(first, first + READ_BLOCKS):
                        count = min(block_tokens, length // width - block * block_tokens)
                        if count <= 0:
                            break
                        ids = _read(f.read_at, block * block_tokens, count, width)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name]), pa.array([block], pa.int64()), pa.array([ids], pa.binary())], names=["file", "block", "ids"]
                        )

    return ranges.repartition("file", "block").mapInArrow(run, "file string, block bigint, ids binary")


def write_token_files(blocks: DataFrame, path: str) -> DataFrame:
    """Writes blocks (file, block, ids, doc_ids), in the order that token_stream gives them, as flat files under path.

    Returns (file, block, doc_ids, path, tokens), kept in the shared folder: what is in the files, without
    the ids. A task writes files of its own name, so what a lost or repeated task left is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = _store(path)
        system.create_dir(folder, recursive=True)
        out, name = None, f"{path.rstrip('/')}/{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.bin"
        try:
            for b in batches:
                size = pa.compute.binary_length(b.column("ids"))
                for ids in b.column("ids"):
                    out = out or system.open_output_stream(_store(name)[1])
                    out.write(ids.as_buffer())
                yield pa.RecordBatch.from_arrays(
                    [b.column("file"), b.column("block"), b.column("doc_ids"), pa.array([name] * b.num_rows), size.cast(pa.int64())],
                    names=["file", "block", "doc_ids", "path", "bytes"],
                )
        finally:
            if out:
                out.close()

    return cut(blocks.select("file", "block", "ids", "doc_ids").mapInArrow(run, "file string, block bigint, doc_ids array<bigint>, path string, bytes bigint"))


def read_written(written: DataFrame, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, doc_ids, ids): the blocks that write_token_files names, read from the files by byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for b in batches:
            ids = []
            for block, name, size in zip(*(b.column(c).to_pylist() for c in ("block", "path", "bytes"))):
                if name != opened:
                    system, at = _store(name)
                    opened, f = name, system.open_input_file(at)
                ids.append(_read(f.read_at, block * block_tokens, size // width, width))
                if len(ids) * block_tokens * width >= 8 << 20:
                    yield from out(b, ids)
                    b, ids = b.slice(len(ids)), []
            yield from out(b, ids)

    def out(b: pa.RecordBatch, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        if ids:
            own = b.slice(0, len(ids))
            yield pa.RecordBatch.from_arrays(
                [own.column("file"), own.column("block"), own.column("doc_ids"), pa.array(ids, pa.binary())], names=["file", "block", "doc_ids", "ids"]
            )

    return written.mapInArrow(run, "file string, block bigint, doc_ids array<bigint>, ids binary")


def token_stream(
    docs: DataFrame, tokenizer: TokenizerFiles, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Texts as flat token files, one for each input partition: (file, block, ids, doc_ids).

    Every document's ids are followed by end_id, and blocks are cut without regard to
    documents. Strings of special tokens are ordinary text, so end_id can be a special token's. doc_ids names the documents that end in a block, in order; the scan doesn't use it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer.encoder(special_as_text=True)
        kind = np.dtype(f"<u{width}")
        file, block, held, names, have = str(TaskContext.get().partitionId()), 0, [], [], 0

        def out(ids: np.ndarray, ended: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([ended], pa.list_(pa.int64()))],
                names=["file", "block", "ids", "doc_ids"],
            )

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py())
                if (ids == end_id).any() or (len(ids) and ids.max() > np.iinfo(kind).max):
                    raise ValueError("the end identifier must be no text's, and all identifiers must fit the width")
                ids = np.append(ids, end_id).astype(kind)
                names.append((have + len(ids) - 1, doc_id))
                held.append(ids)
                have += len(ids)
                if have >= block_tokens:
                    flat = np.concatenate(held)
                    while len(flat) >= block_tokens:
                        ended = [d for at, d in names if at < block_tokens]
                        yield out(flat[:block_tokens], ended)
                        names = [(at - block_tokens, d) for at, d in names[len(ended) :]]
                        flat, block = flat[block_tokens:], block + 1
                    held, have = [flat], len(flat)
        if have:
            yield out(np.concatenate(held), [d for _, d in names])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(
        run, "file string, block bigint, ids binary, doc_ids array<bigint>"
    )


def scan_separators(blocks: DataFrame, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """blocks without ids but with ends (offsets of separators), tokens (ids in the block) and last (global place of its last separator)."""
    rest = [c for c in blocks.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        for b in batches:
            ends, tokens = [], []
            for ids in b.column("ids"):
                flat = np.frombuffer(ids.as_buffer(), dtype=kind)
                ends.append(np.flatnonzero(flat == end_id).astype(np.int32))
                tokens.append(len(flat))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in rest), pa.array(ends, pa.list_(pa.int32())), pa.array(tokens, pa.int64())],
                names=[*rest, "ends", "tokens"],
            )

    kept = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in rest)
    scanned = blocks.mapInArrow(run, f"{kept}, ends array<int>, tokens bigint")
    return scanned.withColumn("last", F.when(F.size("ends") > 0, F.col("block") * block_tokens + F.element_at("ends", -1)))


def count_tokens(blocks: DataFrame, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: file, ordinal, start, tokens, and doc_id where the blocks name it.

    blocks: (file, block, ids[, doc_ids]), blocks numbered from 0 in each file, all but the
    last of block_tokens ids. tokens: the ids before the document's end identifier; start: the
    first one's place in the file. Ids behind a file's last identifier are a document too, with
    ordinal and start but closed false. Null or empty blocks hold nothing; no rows give no rows.
    The blocks are scanned before this returns and what was found is kept in the shared folder, so
    the files are not needed any more.
    """
    blocks = blocks.where("ids is not null")
    scanned = cut(scan_separators(blocks, end_id, width, block_tokens))
    scanned = scanned.withColumn("_group", F.floor(F.col("block") / GROUP_BLOCKS)).withColumn("_count", F.size("ends").cast("long"))
    # the scan's upper level: one row for each group of blocks
    groups = scanned.groupBy("file", "_group").agg(F.max("last").alias("_g_last"), F.sum("_count").alias("_g_count"))
    earlier = Window.partitionBy("file").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        F.col("file").alias("_f"), F.col("_group").alias("_g"),
        F.max("_g_last").over(earlier).alias("_g_last"), F.coalesce(F.sum("_g_count").over(earlier), F.lit(0)).alias("_g_count"),
    )
    inside = Window.partitionBy("file", "_group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        scanned.withColumn("_before", F.max("last").over(inside))
        .withColumn("_index", F.coalesce(F.sum("_count").over(inside), F.lit(0)))
        .join(groups, (F.col("file") == F.col("_f")) & (F.col("_group") == F.col("_g")))
        .withColumn("_before", F.coalesce("_before", "_g_last", F.lit(-1)))
        .withColumn("_index", F.col("_index") + F.col("_g_count"))
    )
    base = F.col("block") * block_tokens
    doc = F.transform(
        "ends",
        lambda e, i: F.struct(
            (F.col("_index") + i).alias("ordinal"),
            (F.when(i == 0, F.col("_before")).otherwise(base + F.get("ends", i - 1)) + 1).alias("start"),
            (base + e).alias("end"),
            (F.get("doc_ids", i) if "doc_ids" in blocks.columns else F.lit(None).cast("long")).alias("doc_id"),
        ),
    )
    closed = placed.select("file", F.explode(doc).alias("d")).select(
        "file", "d.ordinal", "d.start", (F.col("d.end") - F.col("d.start")).alias("tokens"), "d.doc_id", F.lit(True).alias("closed")
    )
    per_file = scanned.groupBy("file").agg(
        F.max(base + F.col("tokens")).alias("size"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.sum("_count").alias("ordinal")
    )
    still_open = per_file.where("size > last + 1").select(
        "file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("size") - F.col("last") - 1).alias("tokens"),
        F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("closed"),
    )
    return closed.unionAll(still_open)
