"""Token counts from a digest cache.

Counts are kept in a table keyed by the digests of the content and of the
tokenizer (its file and the library's version). A run joins its documents to that
table, encodes each distinct text that has no count once, appends those counts to
the table, and joins again. Content is normalised only as far as it leaves every
count alone: null counts as the empty text.

Copies collapse before the shuffle (partial aggregation by digest), so a group of
copies costs one encoding and one shuffled text a task. Joining the counts back
moves ids and digests, never texts; rows of a digest that very many rows have are dealt
to several tasks by salt, whose number follows from the digest's count.

Defined results: null and empty texts have 0 bytes and what the library gives for
the empty text; an empty table gives an empty result and leaves the cache as it was;
repeated rows repeat; only id and text are read. Appending is one atomic Parquet
commit a run; digests that two runs appended at once are read as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib import metadata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_slices

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer: its file's bytes and the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + f"\n{library} {metadata.version(library)}".encode()).hexdigest()


def counter(path: str):
    """A function from texts to token counts, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Counts of one tokenizer, one row a digest; None if there is no cache yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    own = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return own.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, path: str, cache: str) -> str:
    """Encode every distinct text without a count and append the counts; the tokenizer's version."""
    spark = docs.sparkSession
    version = tokenizer_version(path)
    content = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    content = content.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    if (known := read_cache(spark, cache, version)) is not None:
        content = content.join(known.select("digest"), "digest", "left_anti")
    distinct = content.groupBy("digest").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in text_slices(batches, "text", 1 << 20):
            counts = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    distinct.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return version


HOT_ROWS, HOT_DIGESTS = 1_000, 100_000  # rows of one digest that go to one task at least; most digests that are salted


def _hot(keyed: DataFrame) -> DataFrame:
    """Digests that more rows have than one task shall join, and to how many tasks these go; at most ``HOT_DIGESTS``."""
    most = max(HOT_ROWS, -(-keyed.count() // HOT_DIGESTS))
    counts = keyed.groupBy("digest").agg(F.count("*").alias("rows")).where(F.col("rows") > most)
    return counts.select("digest", F.ceil(F.col("rows") / most).cast("int").alias("salts"))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int) -> DataFrame:
    """Bytes, tokens and whether the tokens exceed ``limit`` for every document."""
    version = fill_cache(docs, path, cache)
    known = read_cache(docs.sparkSession, cache, version)
    content = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))
    keyed = materialize(keyed, "digests")
    salts = F.broadcast(_hot(keyed))
    left = keyed.join(salts, "digest", "left").withColumn("salt", (F.monotonically_increasing_id() % F.coalesce("salts", F.lit(1))).cast("int"))
    right = known.join(salts, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    joined = left.join(right.select("digest", "salt", "n_tokens"), ["digest", "salt"], "left")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
