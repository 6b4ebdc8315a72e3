"""Question and answer pairs from stored facts, of several kinds, and their split."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from . import graph
from .context import ordered_join
from .structure import BREADTH

#: Ways to ask for a term; # stands for it.
ASK_TERM = ("What is #?", "Define #.")


def terminology(spark: SparkSession) -> DataFrame:
    """(key, question, answer) for each breadth class and way to ask, from the classes' own thresholds."""
    number = {10: "ten", 3: "three", 2: "two"}
    terms = [(name, f"At least {number[n]} nodes in every generation.") for n, name in BREADTH] + [("gharib", "One node in some generation.")]
    rows = [(f"t{i}_{j}", ask.replace("#", term), meaning) for i, (term, meaning) in enumerate(terms) for j, ask in enumerate(ASK_TERM)]
    return spark.createDataFrame(rows, "key string, question string, answer string")


def chain_pairs(named: DataFrame) -> DataFrame:
    """From chains with names (variant, pos, name, gen): the way a record came."""
    place = F.format_string("%s (generation %d)", "name", "gen")
    rows = named.groupBy("variant").agg(ordered_join(F.col("pos"), place, ", then ").alias("path"), F.count("*").alias("n"))
    return rows.select(
        F.format_string("c%d", "variant").alias("key"), F.format_string("Describe the chain of record %d.", "variant").alias("question"),
        F.format_string("The chain has %d places: %s.", "n", "path").alias("answer"),
    )


def structure_pairs(chains: DataFrame) -> DataFrame:
    """From chains of families with two variants or more: how widely each is handed down."""
    rows = graph.of_two_or_more(chains).groupBy("family").agg(F.count_distinct("variant").alias("variants"), F.count_distinct("node").alias("nodes"))
    return rows.select(
        F.format_string("s%d", "family").alias("key"), F.format_string("How widely is family %d handed down?", "family").alias("question"),
        F.format_string("Family %d has %d variants through %d nodes.", "family", "variants", "nodes").alias("answer"),
    )


def retrieval_pairs(rows: DataFrame, most: int = 300) -> DataFrame:
    """From (id, context, answer): a question over the context's first characters, and a model's or stored answer."""
    return rows.select(
        F.concat(F.lit("r"), "id").alias("key"), F.concat(F.lit("Context:\n"), F.substring("context", 1, most), F.lit("\n\nWhat follows?")).alias("question"), "answer"
    )


def commentary_pairs(rows: DataFrame, most_words: int = 500) -> DataFrame:
    """From (id, text): an explanation of at most most_words words."""
    words = F.slice(F.filter(F.split(collapse(F.col("text")), " "), lambda w: w != ""), 1, most_words)
    return rows.select(F.format_string("v%d", "id").alias("key"), F.format_string("Explain passage %d.", "id").alias("question"), F.array_join(words, " ").alias("answer"))


def label_pairs(rows: DataFrame) -> DataFrame:
    """From (id, source, quality, toxic): facts of two tables in one answer."""
    return rows.select(
        F.format_string("x%d", "id").alias("key"), F.format_string("Which label does passage %d of %s have?", "id", "source").alias("question"),
        F.format_string("Quality %d, toxicity %d.", "quality", "toxic").alias("answer"),
    )


def with_split(parts: Mapping[str, DataFrame], seed: int = 42, held: int = 10) -> DataFrame:
    """category, key, question, answer and split of all parts; one in `held` is for validation, by a hash of seed and key."""
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("category"), "key", "question", "answer")
        out = one if out is None else out.unionAll(one)
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "key").cast("binary")), 1, 6), 16, 10).cast("bigint")
    return out.withColumn("split", F.when(bucket % held == 0, "valid").otherwise("train"))
