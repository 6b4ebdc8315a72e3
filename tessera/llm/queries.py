"""The registered queries of this package: thin contracts over its operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, fingerprints, infill, jaccard, lmscore, merkle, mixing, packing, quality, sharding, tokencount, toxicity, urlfilter
from .oracle import ORACLE_SQL  # noqa: F401
from .session import held_out, remove, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), packing.public_byte_bpe(), 1024, 0)
    return packing.packing_digest(pieces)


def _classified(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _classified(toxicity.toxicity(docs, labels, toxicity.learning_rows()), 0.5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _classified(quality.quality(docs, labels, toxicity.learning_rows()), 0.3)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), threshold=0.8, width=5)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as flat token files, which are scanned for their end identifiers (the vocabulary's end-of-text)."""
    stream = tokencount.token_stream(table(spark, sf_dir, "documents"), packing.public_byte_bpe(), end_id=50256)
    path = scratch(spark, "tokens")
    written = tokencount.write_token_files(stream, path)
    counted = tokencount.count_tokens(tokencount.read_written(written), end_id=50256)
    remove(spark, path)
    return counted.select("doc_id", "file", "ordinal", "start", "tokens", "closed")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = lmscore.language_model_scores(docs, held_out(F.col("doc_id"), 7, 2))
    return scores.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_digest(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "taken", *[F.round(c, 6).alias(c) for c in ("target", "first_position", "second_position")])


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_digest(table(spark, sf_dir, "documents"), 16)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digest(infill.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_fingerprints": op9_fingerprints,
    "op10_mixing": op10_mixing,
    "op11_sharding": op11_sharding,
    "op12_infill": op12_infill,
    "op13_merkle": op13_merkle,
}

