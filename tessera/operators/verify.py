"""Checks of generated text against the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_quote


def quote_is_verbatim(quote: Column, text: Column) -> Column:
    """Whether the quote occurs in the text, marks and spacing aside; false for an empty or null one."""
    q = normalize_quote(F.coalesce(quote, F.lit("")))
    return (q != "") & F.coalesce(F.contains(normalize_quote(text), q), F.lit(False))


def validate_extracts(extracts: DataFrame, allowed: DataFrame, pages: DataFrame) -> DataFrame:
    """extracts (book, page, quote, ...) with reason: null for a sound one, else why it is dropped.

    allowed: (book); pages: (book, page, text). Book first, then page, then quote.
    """
    ok = allowed.select("book").distinct().withColumn("_allowed", F.lit(True))
    found = pages.select("book", "page", F.col("text").alias("_text"))
    rows = extracts.join(ok, "book", "left").join(found, ["book", "page"], "left")
    reason = (
        F.when(F.col("_allowed").isNull(), "book not allowed")
        .when(F.col("_text").isNull(), "no such page")
        .when(~quote_is_verbatim(F.col("quote"), F.col("_text")), "quote not found")
    )
    return rows.withColumn("reason", reason).drop("_allowed", "_text")


def unverified_references(answers: DataFrame, known: DataFrame, window: int = 10, most: int = 10_000) -> DataFrame:
    """(id, number): numbers that stand shortly after 'hadith', '#' or 'number' and are not among the answer's known ones.

    answers: (id, text); known: (id, number). What counts is the text before the word's first occurrence.
    """
    words = answers.select("id", "text", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word"))
    number = F.regexp_extract("word", r"^[^0-9]*([0-9]+)[^0-9]*$", 1).try_cast("bigint")
    rows = words.withColumn("number", number).where((F.col("number") > 0) & (F.col("number") < most))
    at = F.instr("text", F.col("word"))
    before = F.lower(F.substring(F.col("text"), F.greatest(at - window, F.lit(1)), F.least(at - 1, F.lit(window))))
    cue = F.contains(before, F.lit("hadith")) | F.contains(before, F.lit("#")) | F.contains(before, F.lit("number"))
    return rows.where(cue).select("id", "number").distinct().join(known.select("id", "number"), ["id", "number"], "left_anti")
