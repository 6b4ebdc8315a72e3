"""Fill-in-middle transformation: texts rearranged so that a model learns to write what is missing between two parts.

A text is cut at two unit ends that hashes of its id choose. An Arrow-batched pandas UDF finds
the units with one pass of the regex library, keeps nothing but their end offsets in a compact
array, looks two of them up and slices the text there; hashlib gives the seeds and the digest.
Each text is worked on alone: no shuffle, any partitioning, and a rerun gives the same rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .session import text_or_empty

#: A line with its line feed, or the last line without one.
LINES = r"[^\n]*\n|[^\n]+"
#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Characters of output that are held before a batch of results is handed on.
HELD_CHARS = 1 << 22

_SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"


def unit_ends(pattern: regex.Pattern, text: str) -> array:
    """The code-point offsets at which units end, 8 bytes each."""
    return array("q", (m.end() for m in pattern.finditer(text)))


def seeds(seed: int, doc_id: str) -> list[int]:
    """Four numbers of 32 bits from the sha256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _transformer(unit: str, seed: int, rate: int, spm: int, marks: tuple[str, str, str]):
    p, s, m = marks

    @pandas_udf(_SCHEMA)
    def transform(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        names = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]

        def one(doc_id: str, text: str) -> tuple:
            ends = unit_ends(pattern, text)
            n, (h1, h2, h3, h4) = len(ends), seeds(seed, doc_id)
            if not text or any(mark in text for mark in marks) or h3 % 100 >= rate:
                form, begin, end, output = "plain", None, None, text
            else:
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                begin, stop = (ends[k - 1] if k else 0 for k in (first, last))
                end, prefix, middle, suffix = stop - begin, text[:begin], text[begin:stop], text[stop:]
                form = "spm" if h4 % 100 < spm else "psm"
                output = "".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))
            return n, form, begin, end, output, hashlib.sha256(output.encode()).hexdigest()

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

        for ids, texts in batches:
            rows, held = [], 0
            for doc_id, text in zip(ids, texts):
                rows.append(one(doc_id, text))
                held += len(text)
                if held > HELD_CHARS:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    return transform


def fill_in_middle(
    docs: DataFrame, unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output, output_sha256.

    n: units of the text, matches of `unit` from left to right. Of the numbers of units at which
    the id's hashes point, the smaller ends the prefix, the larger the middle; the suffix is the
    rest. form: psm (prefix, suffix, middle) or, in `spm` of 100 cases, spm (suffix, prefix,
    middle), each part behind its mark; plain, the text as it is, for an empty text, for one that
    holds a mark and in all but `rate` of 100 cases. Then prefix_chars and middle_chars (code
    points) are null.
    A null text counts as empty; a null doc_id stays null and is hashed as `null`; rows of equal
    id are cut at the same shares of their units; texts may have any length (8 bytes a unit beside
    the text itself); further columns are ignored, whatever their names; an empty table gives no rows.
    """
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    doc_id = docs["doc_id"].cast("long")
    cut = _transformer(unit, seed, rate, spm, marks)(F.coalesce(doc_id.cast("string"), F.lit("null")), text_or_empty(docs))
    return docs.select(doc_id.alias("doc_id"), cut.alias("_cut")).select("doc_id", "_cut.*")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. No text that was rearranged holds a mark, so each mark is found where it was put."""
    p, s, m = (F.lit(x) for x in marks)
    part = F.split_part
    head, middle = part(output, m, F.lit(1)), part(output, m, F.lit(2))
    psm = F.concat(part(part(head, s, F.lit(1)), p, F.lit(2)), middle, part(head, s, F.lit(2)))
    spm = F.concat(part(head, p, F.lit(2)), middle, part(part(head, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_digest(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The contract's columns: outputs replaced by their digests, and the digest of the text that each gives back."""
    text = restored(F.col("output"), F.col("form"), marks)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(text, 256).alias("restored_sha256")
    )
