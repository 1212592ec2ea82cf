"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_extract, langid, neardup, quality, tokencount, topk, toxicity, wavelet
from .common import id_bucket, labelled_sample, new_path, table

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def language_model(spark: SparkSession, sf_dir: str) -> langid.LanguageModel:
    return langid.learn(table(spark, sf_dir, "documents"), id_bucket("doc_id", 4) != 2)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel | None:
    """From at most 500 toxic and 1,000 other labelled documents, of 5 million characters a class."""
    sample = labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", id_bucket("doc_id", 3) != 1, {0: 1_000, 1: 500}, 4, toxicity.MOST_CHARS)
    return toxicity.train(sample)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), language_model(spark, sf_dir), id_bucket("doc_id", 4) == 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from at most 800 documents of either label."""
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", id_bucket("doc_id", 5) != 0, {0: 800, 1: 800}, 2)
    return quality.score(docs, quality.train(sample), id_bucket("doc_id", 5) == 0)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir), id_bucket("doc_id", 3) == 1)


def op5_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so every distinct text is encoded in this run."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), new_path(spark, "token-cache"), 4096)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.learn(pages))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    wavelet.write_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), path)
    return wavelet.read_documents(spark, path)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_quality, op3_topk, op4_toxicity, op5_tokencount, op6_html, op7_bpe, op8_neardup, op9_wavelet, op10_decontam)}

ORACLE_SQL = {
    "op3_topk": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.n AS qn, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
}
