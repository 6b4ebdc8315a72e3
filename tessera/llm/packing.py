"""Packing by power-of-two decomposition.

Every document, its end identifier included, is cut into pieces whose lengths are powers
of two: as many of the longest length as fit, then the binary digits of the rest. Each
piece is a training sequence of its own, so no sequence crosses documents and none is
padded; sequences of equal length form the buckets from which a trainer draws batches.
The cut needs only one document at a time: no shuffle, no state, any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import text_or_empty

_SCHEMA = "doc_id bigint, start bigint, length bigint, bucket int, doc_tokens bigint, ids binary, number bigint"


class TokenizerFiles:
    """A byte-level BPE given twice: the tokenizers file that defines the ids, and its ranks.

    Ids are those of the tokenizers library. The same merges run several times faster from
    the ranks; texts that hold a special token's string go through tokenizers itself, and so do
    those on which the ranks' regex engine gives up (very long runs of white space).
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.json_path, self.ranks_path, self.pattern = json_path, ranks_path, pattern

    def encoder(self, special_as_text: bool = False):
        """A function from a text to its ids; special tokens' strings in a text are ids of their own unless special_as_text."""
        return _encoder(self.json_path, self.ranks_path, self.pattern, special_as_text)


@lru_cache(maxsize=4)
def _encoder(json_path: str, ranks_path: str | None, pattern: str | None, special_as_text: bool):
    """A function from a text to its ids (uint32), built once in a worker."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    slow.encode_special_tokens = special_as_text
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks_path is None:
        return by_tokenizers
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not special_as_text and any(s in text for s in special):
            return by_tokenizers(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the ranks' regex engine gives up on white space of some hundred thousand characters
            return by_tokenizers(text)

    return encode


def public_byte_bpe() -> TokenizerFiles:
    """The 50k byte-level vocabulary of the public_tokenizers package."""
    import public_tokenizers

    return TokenizerFiles(
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two, none above `longest`, largest first, that sum to n."""
    out = [longest] * (n // longest)
    rest, bit = n % longest, longest >> 1
    while bit:
        if rest & bit:
            out.append(bit)
        bit >>= 1
    return out


#: Bits of a sequence's number that tell a document's pieces apart, where documents have places.
PIECE_BITS = 20


def stored_places(docs: DataFrame) -> tuple[DataFrame, Column] | None:
    """docs as read from files, with each row's place in them: files in order of their names, rows as they were written.

    Spark writes a sorted table in that order, but reads files in another. Rows are counted for each
    file, which reads no column, and nothing is shuffled. None where docs isn't what files hold.
    """
    try:
        read = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return None
    counts = docs.select(F.col("_metadata.file_name").alias("_file")).groupBy("_file").agg(F.count("*").alias("_n"))
    # part numbers have five digits at least: longer ones come later
    number = F.length(F.regexp_extract("_file", r"^part-(\d+)", 1))
    before = Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # one short row for each file, of which the driver lists as many to read them
    return read.join(F.broadcast(first), "_file"), F.col("_first") + F.col("_row")


def pack_documents(
    docs: DataFrame, tokenizer: TokenizerFiles, max_length: int = 1024, end_id: int = 0, place: Column | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, bucket (log2 of length), doc_tokens, ids, sequence_id, offset.

    ids: little-endian unsigned 32-bit token ids. A piece fills its sequence, so offset is 0
    and sequence_id is unique to the piece. place: a row's place among all rows, a different number from 0 for
    each, below 2 to the 43rd; sequence numbers then rise with it, and with start inside a document.
    Without it they rise with partitions and the rows in them. A null or empty text is one piece that holds the
    end identifier alone; texts may have any length, also without a single word, or a single one; repeated rows are packed once
    each; a null doc_id is kept as null; further columns are ignored; an empty table gives no rows. max_length must be a power of two.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer.encoder()
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            doc, start, length, total, number, ids, held = [], [], [], [], [], [], 0

            def flush():
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc, pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(np.log2(np.array(length, dtype=float)).astype(np.int32)),
                        pa.array(total, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(number, pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "bucket", "doc_tokens", "ids", "number"],
                )

            for doc_id, text, at_row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                tokens = np.concatenate([encode(text.as_py()), end]).astype("<u4")
                at, n = 0, len(tokens)
                lengths = piece_lengths(n, max_length)
                if len(lengths) >> PIECE_BITS:
                    raise ValueError(f"a document of {n} tokens has more pieces than numbers")
                number += [(at_row << PIECE_BITS) + i for i in range(len(lengths))]
                for size in lengths:
                    doc.append(doc_id)
                    start.append(at)
                    length.append(size)
                    total.append(n)
                    ids.append(tokens[at : at + size].tobytes())
                    at += size
                held += n
                if held > 1 << 20:
                    yield flush()
                    doc, start, length, total, number, ids, held = [], [], [], [], [], [], 0
            if doc:
                yield flush()

    at = (F.lit(0) if place is None else place).cast("long").alias("place")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"), at)
    number = F.monotonically_increasing_id() if place is None else F.col("number")
    return rows.mapInArrow(cut, _SCHEMA).withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")}).drop("number")


def packing_digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: identifiers replaced by their checksum."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
