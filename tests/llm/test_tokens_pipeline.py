"""Token counts, token files, and the pipeline."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lattix.llm import bpe, decontam, neardup, queries, tokencount, toxicity, wavelet
from lattix.llm.common import TokenTable, new_path

DATA = "/root/testdata/sf0.001"
TEXTS = ["", " ", "the cat,  sat. on", "It's I'LL  DON'T", "Größe\tcafé\r\nñandú 😀😀", "a b\x1cc d　e", "<|endoftext|> <s> </s>", "x" * 3000, "日本語のテキスト", "é é Å ΣΣ İ", "the the, the. THE. the., 12,3", "wo rd " * 20_000]


def table(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(100, None, 7), (None, "a b", 7), (3, TEXTS[3], 7), (3, TEXTS[3], 7), (-5, "last", 7)]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_counts_and_cache(spark):
    rows, docs = table(spark)
    path, cache = P.path(queries.PIECES), new_path(spark, "test-cache")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 3000) for i, t, _ in rows), key=str)
    got = lambda: sorted((tuple(r) for r in tokencount.count_tokens(docs, path, cache, 3000).collect()), key=str)
    assert got() == want
    first = spark.read.parquet(cache)
    assert first.count() == len({t or "" for _, t, _ in rows})
    # a second run encodes nothing; a changed count shows that the stored one is used
    assert got() == want and spark.read.parquet(cache).count() == first.count()
    digest = hashlib.sha256(b"last").digest()
    spark.createDataFrame([(digest, tokencount.tokenizer_version(path), 99)], tokencount.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert {r[0]: r[2] for r in got()}[-5] == 99
    spark.createDataFrame([(digest, "other version", 5000)], tokencount.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert {r[0]: r[2] for r in got()}[-5] == 99
    more = docs.union(spark.createDataFrame([(200, "something new", 1)], docs.schema))
    before = spark.read.parquet(cache).count()
    assert tokencount.count_tokens(more, path, cache, 3000).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == before + 1
    assert tokencount.count_tokens(docs.limit(0), path, new_path(spark, "test-cache"), 5).count() == 0


def test_counts_of_hot_digests(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "HOT_ROWS", 4)
    rows = [(i, ["", None, "the cat", "a", "b"][i % 5]) for i in range(100)] + [(None, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=P.path(queries.PIECES))
    got = tokencount.count_tokens(docs, P.path(queries.PIECES), new_path(spark, "test-cache"), 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, len(t or ""), len(library.encode(t or "")), len(library.encode(t or "")) > 1) for i, t in rows), key=str)


def test_counts_of_a_json_tokenizer():
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert tokencount.counter(path)(TEXTS) == [len(x.ids) for x in library.encode_batch(TEXTS, add_special_tokens=False)]


@pytest.mark.parametrize(("n", "kinds"), [(0, 1), (1, 1), (5, 1), (1000, 1), (3000, 700), (5000, 40_000), (513, 2)])
def test_wavelet_matrix(n, kinds):
    r = np.random.default_rng(n)
    ids = r.integers(0, kinds, n).astype(np.uint32)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert np.array_equal(w.tokens(), ids)
    for i in r.integers(0, max(n, 1), min(n, 40)).tolist():
        places = np.flatnonzero(ids == ids[i])
        assert w.access(i) == ids[i] and w.count(int(ids[i])) == len(places)
        assert w.count(int(ids[i]), 3, n - 1) == ((places >= 3) & (places < n - 1)).sum()
        for k in {0, len(places) // 2, len(places) - 1}:
            assert w.occurrence(int(ids[i]), k) == places[k]
        assert w.occurrence(int(ids[i]), len(places)) == -1
    assert w.count(10**6) == 0 and w.occurrence(10**6, 0) == -1
    with pytest.raises(IndexError):
        w.access(n)


def test_wavelet_matrix_of_large_ids():
    ids = np.array([2**31, 5, 2**31, 7], np.uint32)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert np.array_equal(w.tokens(), ids) and w.occurrence(2**31, 1) == 2


def noise(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["a", "th", "ion", "É", "ß", "'", "s", "1", ".", ",", "ż", "A", "\n", "-"]) for _ in range(r.randrange(6))) for _ in range(n))


def test_words_are_encoded_as_whole_texts():
    texts = TEXTS[:-1] + [noise(k, 60) for k in range(80)] + ["İstanbul ΣΊΣΥΦΟΣ. ΟΔΟΣ, Ǆ ǅ ŉ ẞ. ß, Å E\u0301a. ﬁ, ª º. Ⅷ, x²."]
    library = Tokenizer.from_file(P.path(queries.WORDS))
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    e = wavelet.WordEncoder(P.path(queries.WORDS), most_bases=80)  # a small table, so it empties
    for _ in range(2):
        ids, counts = e.encode(pa.array(texts))
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_token_files(spark):
    rows, docs = table(spark)
    library = Tokenizer.from_file(P.path(queries.WORDS))
    path = new_path(spark, "test-tokens")
    wavelet.write_blocks(docs, P.path(queries.WORDS), path, block_tokens=500, shard_rows=5)
    got = sorted((tuple(r) for r in wavelet.read_documents(spark, path).collect()), key=lambda r: r[1])
    ids = {id(r): [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    want = sorted(((r[0], len(ids[id(r)]), zlib.crc32(np.array(ids[id(r)], "<u4").tobytes())) for r in rows), key=str)
    assert sorted(((a, n, c) for a, _, n, c in got), key=str) == want
    # access, count and occurrence from the files
    order = {start: r for r, start in ((r, r[1]) for r in got)}
    every: list[int] = []
    left = [r for r in rows]
    for start in sorted(order):
        doc, _, n, crc = order[start]
        row = next(r for r in left if r[0] == doc and len(ids[id(r)]) == n and zlib.crc32(np.array(ids[id(r)], "<u4").tobytes()) == crc)
        left.remove(row)
        every += ids[id(row)]
    every = np.array(every)
    for at in (0, 1, len(every) // 2, len(every) - 1):
        assert wavelet.access(spark, path, at) == every[at]
    with pytest.raises(IndexError):
        wavelet.access(spark, path, len(every))
    for token in (2, int(every[5]), 48_000_000):
        places = np.flatnonzero(every == token)
        assert wavelet.count(spark, path, token) == len(places)
        assert wavelet.count(spark, path, token, 10, 4_000) == ((places >= 10) & (places < 4_000)).sum()
        for k in {0, len(places) - 1} if len(places) else ():
            assert wavelet.occurrence(spark, path, token, int(k)) == places[k]
        assert wavelet.occurrence(spark, path, token, len(places)) == -1
    empty = new_path(spark, "test-tokens")
    wavelet.write_blocks(docs.limit(0), P.path(queries.WORDS), empty)
    assert wavelet.read_documents(spark, empty).count() == 0


def test_bpe_digests(spark):
    rows, docs = table(spark)
    ranks = bpe.read_ranks(P.path(queries.BYTE_RANKS))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.digests(docs, P.path(queries.BYTE_RANKS), P.PATTERN)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert bpe.digests(docs.limit(0), P.path(queries.BYTE_RANKS), P.PATTERN).count() == 0


def test_topk_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = c.sql(queries.ORACLE_SQL["op3_topk"]).fetchall()
    got = queries.op3_topk(spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline_against_its_parts(spark):
    """Each stage against the plain form of its decision, on what the stage before kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("text", F.when(F.col("doc_id") == 7, F.lit("12 34")).otherwise(F.col("text")))
    (_, language), (_, tox), (_, dedup), (_, decon), (_, encode) = corpus_pipeline.STAGES
    model = toxicity.train([])
    assert model is None
    a = language(spark, docs, DATA)
    assert a.schema == docs.schema and a.where("doc_id = 7").count() == 0 and a.count() == docs.count() - 1
    b = tox(spark, a, DATA).cache()
    m = queries.toxicity_model(spark, DATA)
    rows = a.collect()
    score, _ = toxicity.score_texts(m, m and TokenTable(m.span_scores, 1), [r["text"] for r in rows])
    assert {r["doc_id"] for r in b.collect()} == {r["doc_id"] for r, s in zip(rows, score, strict=True) if s < toxicity.THRESHOLD}
    c = dedup(spark, b, DATA).cache()
    heads = {r["class_id"] for r in neardup.classes(b).collect()}
    assert {r["doc_id"] for r in c.collect()} == heads and c.count() == len(heads)
    d = decon(spark, c, DATA).cache()
    bench = [decontam.normalise(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in d.collect()}
    for r in c.collect():
        text = decontam.normalise(r["text"])
        if any(t in text for t in bench):
            assert r["doc_id"] not in left
    out = encode(spark, d, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(left)
    for r in out.join(d.select("doc_id", "text"), "doc_id").collect():
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert corpus_pipeline.run(spark, DATA).count() > 0
