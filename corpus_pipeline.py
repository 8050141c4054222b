"""The corpus pipeline: language ID, quality rules, one of each group of near-copies, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All stages but the last return the columns of documents. Null texts, texts without letters and documents that the rules
reject leave early; rows that the mix takes more than once are there as many times. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, jaccard_join, language_id, line_rules, mixing
from quillstone.llm.storage import removed, small_batches, stored, temporary


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: texts without a letter go, and those in which the best language's score is not a
    quarter above the mean of the other languages'. Where only one language is learned, all texts with a letter stay."""
    small_batches(spark)
    model = language_id.train(docs)
    told = language_id.identify(docs, model, out="__language")
    best = F.col("__language.score")  # a share: the others have the rest
    sure = best * (len(model.languages) - 1) >= 1.25 * (1 - best)
    return told.where((F.col("__language.lang_pred") != language_id.NONE) & sure).select(*_columns(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules on words and on lines shared between documents keep, without the lines above the limit."""
    small_batches(spark)
    return line_rules.refined(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document with the smallest id."""
    small_batches(spark)
    return jaccard_join.one_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    size = mixing.word_count(F.col("text"))
    mixed = mixing.mix(docs, size, mixing.plain_share(F.col("text"), size), prefix="__mixed_")
    return mixing.repeated(mixed, _columns(docs), prefix="__mixed_")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text for each document of the mix."""
    small_batches(spark)
    out = bpe.encode_digests(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "bpe.*")


STAGES = [
    ("language_id", languages),
    ("quality_rules", quality_rules),
    ("jaccard_join", near_copies),
    ("mixing", source_mix),
    ("bpe", tokens),
]

ORACLE_SQL = None  # SQL has no kernel ridge regression and no byte-pair encoding


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each stage's table goes as soon as the next one's is written."""
    out, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with temporary(spark):
            out, path = stored(stage(spark, out, sf_dir))
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, out, sf_dir)
