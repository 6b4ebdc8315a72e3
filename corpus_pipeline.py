"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, mixing, packing, quality, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Every stage keeps the columns of documents and gives no rows for an empty table; what it does with null and
# empty texts, repeated rows and null ids is said here in short and in full by the operator that it calls.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the class-conditional models reject go. Null texts count as empty; equal texts stay or go together; null ids don't matter."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the boosted trees reject go. Null texts count as empty; equal texts stay or go together; null ids don't matter."""
    return quality.drop_low_quality(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that links of five-word Jaccard similarity 0.8 join stays, the one of least id.

    Null and empty texts are one group; rows without an id stay; a repeated id is in the groups of all its texts.
    """
    return jaccard.keep_one_of_each(docs, threshold=0.8, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target takes them, in the order of training, in which they are written too.

    Texts without words are never taken; null sources are one source; repeated rows are mixed one by one.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining row, cut into sequences of power-of-two lengths, numbered in the order of training in which mixing wrote the rows.

    A text without words is its end identifier alone. Rows that come from no files are numbered as their partitions follow each other.
    """
    placed, place = packing.stored_places(docs) or (docs, None)
    return packing.pack_documents(placed, packing.public_byte_bpe(), 1024, 0, place)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models and tokenizers decide rows, so SQL can't express the run; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage has read is removed when it is written."""
    from tessera.llm.session import remove, scratch

    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
