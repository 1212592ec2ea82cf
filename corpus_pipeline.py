"""A training corpus from ``documents``: known languages, no toxic text, one of each near-duplicate class, no benchmark text, token digests.

Each stage is a function of (spark, docs, sf_dir). All but the last return rows of
``docs`` as they are; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

Null and empty texts go at the first stage (they have no letter). Null ids stay. Repeated
rows are near-duplicates of each other: one stays. Very long texts are read whole, an
empty table passes through, and columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattix.llm import bpe, decontam, langid, neardup, toxicity
from lattix.llm.common import materialize, table
from lattix.llm.queries import BYTE_RANKS, language_model, toxicity_model


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and texts that no learned language explains."""
    return langid.keep_known(docs, language_model(spark, sf_dir))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class."""
    return neardup.keep_one(docs)


def not_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that contain a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near-dedup", one_of_each), ("decontamination", not_benchmark), ("encoding", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
