"""Token ids in wavelet matrices.

Documents go to shards by ranges of (doc_id, content hash) and are sorted there,
so shards and their blocks follow ascending doc_id. A block of consecutive
documents becomes one wavelet matrix: its ids are numbered by the sorted distinct
ids of the block, and each bit of those numbers is a plane of packed bits, with
counts of ones every 512 bits. From the one compressed value the id at a place, the
number of occurrences in a range and the place of the k-th occurrence can be read
without decoding the rest.

Files are Parquet written by Spark (its commit protocol covers lost executors), one
file a shard and one row a block of about a million tokens, so memory stays bounded;
``access``, ``count`` and ``occurrence`` answer for all files by places among all ids. Words (text between spaces and line ends) are encoded by the library
once each a worker: its normaliser and splitter treat them by themselves.

Defined results: null and empty texts consist of the end id; null doc_ids come
first; equal doc_ids are ordered by the hash of their text, equal rows arbitrarily;
an empty table gives no block and an empty result; only id and text are read. A
document is never cut; a block closes after the document that fills it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_slices, worker_slot

BLOCK_SCHEMA = "shard int, block int, n_docs long, n_tokens long, doc_ids binary, known_ids binary, lengths binary, matrix binary"
SPAN = 512
HEAD = np.dtype("<u4")


class WaveletMatrix:
    """A sequence of non-negative ids below 2 ** 32."""

    def __init__(self, symbols: np.ndarray, size: int, planes: np.ndarray, ones: np.ndarray):
        self.symbols, self.size, self.planes, self.ones = symbols, size, planes, ones
        self.levels = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        highest = int(ids.max()) if len(ids) else 0
        if highest < 1 << 22:
            used = np.zeros(highest + 1, bool)
            used[ids] = True
            symbols = np.flatnonzero(used)
            number = np.cumsum(used, dtype=np.uint32) - 1
            values = number.astype(np.uint16 if len(symbols) <= 1 << 16 else np.uint32)[ids]
        else:
            symbols, values = np.unique(ids, return_inverse=True)
            values = values.astype(np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        levels = max(1, int(len(symbols) - 1).bit_length()) if len(ids) else 0
        words = -(-len(ids) // SPAN) * SPAN // 8
        planes = np.zeros((levels, words), np.uint8)
        ones = np.zeros((levels, words * 8 // SPAN + 1), HEAD)
        for level in range(levels):
            bit = (values >> (levels - 1 - level)) & 1 == 1
            packed = np.packbits(bit)
            planes[level, : len(packed)] = packed
            np.cumsum(np.bitwise_count(planes[level].view(np.uint64)).reshape(-1, SPAN // 64).sum(1), out=ones[level, 1:])
            if level < levels - 1:
                zero = np.compress(~bit, values)
                values = np.concatenate([zero, np.compress(bit, values)])
        return cls(symbols.astype(HEAD), len(ids), planes, ones)

    def to_bytes(self) -> bytes:
        head = np.array([self.size, len(self.symbols), self.levels, self.planes.shape[1] if self.levels else 0], HEAD)
        return b"".join(x.tobytes() for x in (head, self.symbols, self.ones, self.planes))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        size, symbols, levels, words = (int(x) for x in np.frombuffer(data, HEAD, 4))
        at = 16 + 4 * symbols
        spans = words * 8 // SPAN + 1
        ones = np.frombuffer(data, HEAD, levels * spans, at).reshape(levels, spans)
        planes = np.frombuffer(data, np.uint8, levels * words, at + 4 * levels * spans).reshape(levels, words)
        return cls(np.frombuffer(data, HEAD, symbols, 16), size, planes, ones)

    def _rank(self, level: int, at: int) -> int:
        """Ones before place ``at`` of a plane."""
        span, rest = divmod(at, SPAN)
        count = int(self.ones[level, span])
        if rest:
            first = span * SPAN // 8
            part = self.planes[level, first : first + -(-rest // 8)].copy()
            if rest % 8:
                part[-1] &= 0xFF << (8 - rest % 8) & 0xFF
            count += int(np.bitwise_count(part).sum())
        return count

    def _find(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level]), dtype=np.int64) * SPAN - self.ones[level]
        span = int(np.searchsorted(before, k, "right")) - 1
        first = span * SPAN // 8
        bits = np.unpackbits(self.planes[level, first : first + SPAN // 8])
        return span * SPAN + int(np.flatnonzero(bits == bit)[k - int(before[span])])

    def _zeros(self, level: int) -> int:
        return self.size - int(self.ones[level, -1])

    def access(self, at: int) -> int:
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for level in range(self.levels):
            bit = int(self.planes[level, at >> 3]) >> (7 - (at & 7)) & 1
            value = value << 1 | bit
            ones = self._rank(level, at)
            at = self._zeros(level) + ones if bit else at - ones
        return int(self.symbols[value])

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int, int] | None:
        number = int(np.searchsorted(self.symbols, token))
        if number >= len(self.symbols) or self.symbols[number] != token:
            return None
        for level in range(self.levels):
            a, b = self._rank(level, begin), self._rank(level, end)
            if number >> (self.levels - 1 - level) & 1:
                begin, end = self._zeros(level) + a, self._zeros(level) + b
            else:
                begin, end = begin - a, end - b
        return number, begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of ``token`` among places ``begin`` to ``end``."""
        begin, end = max(0, begin), min(self.size, self.size if end is None else end)
        got = self._range(token, begin, end) if begin < end else None
        return got[2] - got[1] if got else 0

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of ``token``; -1 if there are fewer."""
        got = self._range(token, 0, self.size)
        if not got or not 0 <= k < got[2] - got[1]:
            return -1
        number, at = got[0], got[1] + k
        for level in range(self.levels - 1, -1, -1):
            bit = number >> (self.levels - 1 - level) & 1
            at = self._find(level, bit, at - self._zeros(level) if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids, from the last plane back to the first."""
        kind = np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32
        values = np.zeros(self.size, kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.size).view(bool)
            zeros = self._zeros(level)
            up = np.empty_like(values)
            up[np.flatnonzero(~bit)] = values[:zeros]
            up[np.flatnonzero(bit)] = values[zeros:] | kind(1 << (self.levels - 1 - level))
            values = up
        return self.symbols[values] if self.size else np.zeros(0, HEAD)


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file, each distinct word of a batch looked up once.

    Arrow splits a batch into words and numbers the distinct ones. A word of letters with
    at most a full stop or comma behind it is the ids of its lower case and the sign's.
    Words of letters go through the library many at a time; the tokens that end a word
    part their ids again. Any other word goes by itself.
    """

    SIGNS = ("", ".", ",")

    def __init__(self, path: str, most_bases: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.most_bases = most_bases
        self.sign_ids = [self._alone([x])[0] if x else [] for x in self.SIGNS]
        self.bases: dict[str, int] = {}
        self.base_ids = _Pool()

    def _alone(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _places(self, keys: list[str]) -> np.ndarray:
        """The number of every key; keys not seen before are encoded."""
        if len(self.bases) > self.most_bases:
            self.bases, self.base_ids = {}, _Pool()
        new = [w for w in keys if w not in self.bases]
        plain = [w for w in new if w.isalpha() and w == w.lower()]
        rest = [w for w in new if not (w.isalpha() and w == w.lower())]
        for k in range(0, len(plain), 1_000):
            some = plain[k : k + 1_000]
            together = np.array(self._alone([" ".join(some)])[0], np.uint32)
            cut = np.flatnonzero(self.ends_word[together]) + 1
            if len(cut) == len(some) and cut[-1] == len(together):
                self._keep(some, together, np.diff(cut, prepend=0))
            else:
                rest += some
        for k in range(0, len(rest), 1_000):
            lists = self._alone(rest[k : k + 1_000])
            self._keep(rest[k : k + 1_000], np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists))), np.fromiter(map(len, lists), np.int64, len(lists)))
        return np.fromiter(map(self.bases.__getitem__, keys), np.int64, len(keys))

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.bases.update(zip(words, range(len(self.bases), len(self.bases) + len(words)), strict=True))
        self.base_ids.add(ids, lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the count of each; null counts as empty."""
        whole = pc.fill_null(texts.cast(pa.large_string()), "")
        for white in "\n\t\r":
            whole = pc.replace_substring(whole, white, " ")
        split = pc.split_pattern(whole, " ")
        counts = np.asarray(pc.list_value_length(split)).astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        word = numbered.dictionary
        stop, comma = (np.asarray(pc.ends_with(word, x)) for x in self.SIGNS[1:])
        base = pc.if_else(pa.array(stop | comma), pc.utf8_slice_codeunits(word, 0, -1), word)
        # case that depends on the context, or that takes more than one character, is left to the library
        odd = pc.or_(pc.match_substring(base, "\u03a3"), pc.match_substring(base, "\u0130"))
        plain = pc.and_not(pc.utf8_is_alpha(base), odd)
        keys = pc.if_else(plain, pc.utf8_lower(base), word).dictionary_encode()
        place = self._places(keys.dictionary.to_pylist())[np.asarray(keys.indices)]
        sign = np.where(np.asarray(plain), stop + 2 * comma, 0)
        ids, length = self.base_ids.gather(place)
        extra = np.array([len(x) for x in self.sign_ids])[sign]
        if extra.any():
            ids = np.insert(ids, np.repeat(np.cumsum(length), extra), [i for s in sign[extra > 0].tolist() for i in self.sign_ids[s]])
        own = _Pool()
        own.add(ids, length + extra)
        ids, length = own.gather(np.asarray(numbered.indices))
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)


class _Pool:
    """Short id lists one after another."""

    def __init__(self):
        self.ids, self.start, self.length = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = self.lists = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.lists + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.lists : self.lists + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.lists : self.lists + len(lengths)] = lengths
        self.used += len(ids)
        self.lists += len(lengths)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[at]
        total = np.cumsum(length)
        places = np.repeat(self.start[at] - total + length, length)
        return self.ids[places + np.arange(len(places))], length


def write_blocks(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, block_tokens: int = 1_000_000, shard_rows: int = 8_000) -> None:
    """Encode and write all documents. ``shard_rows`` sets how many shards there are, not how long one may be."""
    rows = docs.count()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(max(1, -(-rows // shard_rows)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_slot(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        shard = TaskContext.get().partitionId()
        block, ids, lengths, keys = 0, [], [], []

        def close() -> pa.RecordBatch:
            nonlocal block, ids, lengths, keys
            length = np.concatenate(lengths)
            matrix = WaveletMatrix.build(np.concatenate(ids))
            doc = [k for x in keys for k in x]
            row = [shard, block, len(doc), int(length.sum()), np.array([0 if k is None else k for k in doc], "<i8").tobytes(), np.packbits([k is not None for k in doc]).tobytes(), length.astype(HEAD).tobytes(), matrix.to_bytes()]
            block, ids, lengths, keys = block + 1, [], [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "block", "n_docs", "n_tokens", "doc_ids", "known_ids", "lengths", "matrix"])

        held = 0
        for batch in text_slices(batches, "text", 4 << 20):
            got, count = encoder.encode(batch.column("text"))
            ends = np.cumsum(count)
            with_end = np.full(len(got) + len(count), end_id, np.uint32)
            keep = np.ones(len(with_end), bool)
            keep[ends + np.arange(len(count))] = False
            with_end[keep] = got
            ids.append(with_end)
            lengths.append(count + 1)
            keys.append(batch.column("doc_id").to_pylist())
            held += len(with_end)
            if held >= block_tokens:
                yield close()
                held = 0
        if held:
            yield close()

    ranged.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


RUN = 4_096  # shards whose totals one window adds up


def _running(blocks: DataFrame, value: str) -> DataFrame:
    """``shard, block, before, <value>``: the sum of ``value`` over all blocks before each.

    In three steps (blocks of a shard, shards of a run, runs), so that the only window in
    one task has a row for each ``RUN`` shards.
    """

    def before(window) -> Column:
        return F.sum(value).over(window.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(value)

    run = F.floor(F.col("shard") / RUN).alias("run")
    shards = blocks.groupBy("shard").agg(F.sum(value).alias(value))
    runs = shards.groupBy(run).agg(F.sum(value).alias(value)).select("run", before(W.orderBy("run")).alias("before_run"))
    placed = shards.select("shard", run, before(W.partitionBy(run).orderBy("shard")).alias("before_shard")).join(runs, "run")
    own = blocks.select("shard", "block", value, before(W.partitionBy("shard").orderBy("block")).alias("before_block"))
    return own.join(placed, "shard").select("shard", "block", (F.col("before_run") + F.col("before_shard") + F.col("before_block")).alias("before"), value)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def access(spark: SparkSession, path: str, at: int) -> int:
    """The id at a place among all ids of the files, from the one block that has it."""
    places = _running(_files(spark, path).select("shard", "block", "n_tokens"), "n_tokens")
    found = places.where((F.col("before") <= at) & (F.col("before") + F.col("n_tokens") > at)).first()
    if found is None:
        raise IndexError(at)
    return _matrix(spark, path, found).access(at - found["before"])


def _matrix(spark: SparkSession, path: str, where) -> WaveletMatrix:
    row = _files(spark, path).where((F.col("shard") == where["shard"]) & (F.col("block") == where["block"])).select("matrix").first()
    return WaveletMatrix.from_bytes(row["matrix"])


def _counted(spark: SparkSession, path: str, token: int, begin: int = 0, end: int | None = None) -> DataFrame:
    """Occurrences of ``token`` in each block, by rank on its matrix."""
    blocks = _files(spark, path)
    if begin > 0 or end is not None:
        blocks = blocks.join(_running(blocks.select("shard", "block", "n_tokens"), "n_tokens").drop("n_tokens"), ["shard", "block"])
        blocks = blocks.where(F.col("before") + F.col("n_tokens") > begin)
        blocks = blocks.where(F.col("before") < end) if end is not None else blocks
    else:
        blocks = blocks.withColumn("before", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [WaveletMatrix.from_bytes(r["matrix"]).count(token, max(0, begin - r["before"]), None if end is None else max(0, end - r["before"])) for r in batch.select(["before", "matrix"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("block"), pa.array(counts, pa.int64())], names=["shard", "block", "found"])

    return blocks.select("shard", "block", "before", "matrix").mapInArrow(run, "shard int, block int, found long")


def count(spark: SparkSession, path: str, token: int, begin: int = 0, end: int | None = None) -> int:
    """Occurrences of ``token`` among places ``begin`` to ``end`` of the files."""
    return _counted(spark, path, token, begin, end).agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0]


def occurrence(spark: SparkSession, path: str, token: int, k: int) -> int:
    """The place of the k-th (from 0) occurrence of ``token`` in the files; -1 if there are fewer."""
    found = _running(_counted(spark, path, token), "found").where((F.col("before") <= k) & (F.col("before") + F.col("found") > k)).first()
    if found is None:
        return -1
    starts = _running(_files(spark, path).select("shard", "block", "n_tokens"), "n_tokens")
    first = starts.where((F.col("shard") == found["shard"]) & (F.col("block") == found["block"])).first()["before"]
    return first + _matrix(spark, path, found).occurrence(token, k - found["before"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document its first place among all ids, its number of ids and their crc32, read from the files.

    The start of a block is a running sum over the blocks.
    """
    blocks = _files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(r["matrix"]).tokens().astype("<u4", copy=False)
                length = np.frombuffer(r["lengths"], HEAD).astype(np.int64)
                known = np.unpackbits(np.frombuffer(r["known_ids"], np.uint8), count=r["n_docs"]).view(bool)
                first = np.cumsum(length) - length
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                n = len(length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["shard"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=~known), pa.array(first), pa.array(length), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "first", "n_tokens", "ids_crc32"])

    decoded = blocks.select("shard", "block", "n_docs", "doc_ids", "known_ids", "lengths", "matrix").mapInArrow(run, "shard int, block int, doc_id long, first long, n_tokens long, ids_crc32 long")
    starts = _running(blocks.select("shard", "block", "n_tokens"), "n_tokens").drop("n_tokens")
    return decoded.join(starts, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
