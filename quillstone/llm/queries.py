"""One query for each operator, over its whole table, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hmm, jaccard_join, language_id, line_rules, minhash, mixing, near_dedup, quality, spelling, token_counts, toxicity, whitening
from .storage import small_batches, written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.encode_digests(documents(spark, sf_dir).select("doc_id", "text"), path)
    return out.select("doc_id", "bpe.*")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_counts.token_counts(documents(spark, sf_dir).select("doc_id", "text"), path)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = mixing.word_count(F.col("text"))
    known = documents(spark, sf_dir).select("doc_id", "source", size.alias("size"), mixing.plain_share(F.col("text"), size).alias("weight"))
    out = mixing.mix(written(known), F.col("size"), F.col("weight"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir).select("doc_id", "text"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir), threshold=0.3)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two categories are labelled: texts of low quality, then toxic texts."""
    known = labels(spark, sf_dir).select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    out = toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), known, ["low_quality", "toxic"])
    return out.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.low_quality").alias("low_quality_score"),
        F.col("toxicity.toxic").alias("score"),
        F.col("toxic_pred").alias("predicted"),
    )


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules.rules(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", *line_rules.STATS, "base_failed", "kept", "depleted", "lost_words", "cleaned_md5")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir).select("doc_id", "text"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(documents(spark, sf_dir).select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "language.*")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir).select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return whitening.components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_hmm": op4_hmm,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_line_rules": op7_line_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_minhash": op9_minhash,
    "op10_language_id": op10_language_id,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_near_dedup": op13_near_dedup,
}

SQL: dict[str, str] = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op8_jaccard_join": jaccard_join.oracle_sql(jaccard_join.WORDS, jaccard_join.PERCENT),
    "op13_near_dedup": jaccard_join.oracle_sql(near_dedup.WORDS, near_dedup.PERCENT, kept=True),
}
