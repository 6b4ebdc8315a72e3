"""Checks of what a caller asks for, before anything is planned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that callers may update, by table: fixed values.
UPDATABLE = {"hadith": ("text_en", "name_en"), "narrator": ("text_en", "name_en")}
MOST_ROWS = 100


def updatable(table: str, field: str, allowed: Mapping[str, Sequence[str]] = UPDATABLE) -> tuple[str, str]:
    """The names themselves, if a caller may name them; they are never taken into a plan otherwise."""
    if field not in allowed.get(table, ()):
        raise ValueError(f"{table}.{field} is not open to callers")
    return table, field


def page_bounds(page: int | None, limit: int | None, usual: int = 20, most: int = MOST_ROWS) -> tuple[int, int]:
    """(offset, limit) of a page from 1, with at least one row and at most `most` to a page."""
    size = min(max(1, usual if limit is None else limit), most)
    return (max(1, page or 1) - 1) * size, size


def window_bounds(start: int, stop: int, most: int) -> tuple[int, int]:
    """A window of pages from 0, of at least one and at most `most`."""
    start = max(0, start)
    return start, min(max(stop, start + 1), start + most)


def vector_length(vectors: DataFrame, column: str) -> int | None:
    """The length of the first stored vector, read alone; None where none is stored."""
    row = vectors.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).limit(1).first()
    return row["n"] if row else None


def require_length(vectors: DataFrame, column: str, wanted: int) -> None:
    """An error where stored vectors are not of the length that a model gives: they must be embedded again."""
    have = vector_length(vectors, column)
    if have is not None and have != wanted:
        raise ValueError(f"stored vectors have {have} components, the model gives {wanted}")
