"""Heading trees: flattening, subtrees, titles of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate_bytes
from .storage import materialize

NODE = "title string, line_num bigint, text string, summary string, nodes string"


def flatten_tree(roots: DataFrame, book: str, nodes: str) -> DataFrame:
    """(book, path, depth, title, line_num, text, summary) of every node of JSON forests, level by level to the last.

    roots: one row for each book with its list of nodes as a JSON string; children stay JSON until
    their level is read, so depth needs no schema and has no limit. Malformed levels end there.
    """
    listed = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in NODE.split(', '))}>>"
    level = roots.select(F.col(book).alias("book"), F.lit("").alias("prefix"), F.col(nodes).alias("children"))
    out, depth = None, 0
    while out is None or not level.isEmpty():
        parsed = level.select("book", "prefix", F.posexplode(F.from_json("children", listed)).alias("i", "n"))
        path = F.concat(F.col("prefix"), F.lpad(F.col("i").cast("string"), 4, "0"))
        here = materialize(parsed.select("book", path.alias("path"), F.lit(depth).alias("depth"), "n.title", "n.line_num", "n.text", "n.summary", "n.nodes"))
        rows = here.drop("nodes")
        out = rows if out is None else out.unionAll(rows)
        level, depth = here.where("nodes is not null").select("book", F.concat("path", F.lit(".")).alias("prefix"), F.col("nodes").alias("children")), depth + 1
    return out


def level_one(flat: DataFrame) -> DataFrame:
    """The chapters of flattened books: children of each book's first node, in order."""
    return flat.where("depth = 1 and path like '0000.%'").select("book", F.col("path").alias("chapter"), "line_num", "title", summary(F.col("summary")).alias("summary"))


def subtree_lines(flat: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, chapter, line_num) of all nodes under each chapter (book, chapter: its path), the chapter itself left out."""
    under = flat.select("book", "line_num", F.col("path").alias("_p"), F.slice(F.split("path", r"\."), 1, 2).alias("_two"))
    rows = chapters.select("book", "chapter", F.split("chapter", r"\.").alias("_two"))
    return under.join(rows, ["book", "_two"]).where("_p <> chapter and line_num is not null").select("book", "chapter", "line_num").distinct()


def summary(text: Column, most: int = 250) -> Column:
    """A node's summary of at most `most` bytes, null where it has none."""
    return truncate_bytes(F.nullif(text, F.lit("")), most)


def headings_tree(headings: DataFrame, group: str, order: str, level: str) -> DataFrame:
    """headings with parent: the last heading before it of a lower level.

    One window for each level that occurs, none over pairs of headings.
    """
    deepest = headings.agg(F.max(level)).first()[0] or 1
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(w) for k in range(1, deepest + 1)}
    parent = F.lit(None).cast(headings.schema[order].dataType)
    for k in range(2, deepest + 1):
        lower = [last[j] for j in range(1, k)]
        parent = F.when(F.col(level) == k, F.greatest(*lower) if len(lower) > 1 else lower[0]).otherwise(parent)
    return headings.withColumn("parent", parent)


def title_at(headings: DataFrame, places: DataFrame, group: str, line: str) -> DataFrame:
    """places with the title of the heading on their line, else of the last one before it."""
    every = headings.select(group, F.col(line).alias("_l"), F.lit(0).alias("_k"), "title", F.lit(None).cast("bigint").alias("_p")).unionAll(
        places.select(group, F.col(line).alias("_l"), F.lit(1), F.lit(None).cast("string"), F.col(line).cast("bigint"))
    )
    w = Window.partitionBy(group).orderBy("_l", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("title", F.last("title", ignorenulls=True).over(w)).where("_k = 1").select(group, F.col("_p").alias(line), "title")
