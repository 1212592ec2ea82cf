"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of its own only where none is configured and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lattix-"))
        spark.sparkContext.setCheckpointDir(_own_dir[0])
    return _own_dir[0]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lattix/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that ``materialize`` returned."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 hashes the empty text for null ids."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def strings(array: pa.Array) -> list[str]:
    """An Arrow text column as Python strings, null as the empty one."""
    return ["" if x is None else x for x in array.to_pylist()]


_slot: list[tuple] = []


def worker_slot(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, kept for later tasks with this key in this Python worker; one key at a time."""
    if not _slot or _slot[0][0] != key:
        _slot.clear()
        tidy()
        _slot.append((key, make()))
    return _slot[0][1]


def free_slot() -> None:
    """Drop what another operator left in this worker."""
    if _slot:
        _slot.clear()
        tidy()


def tidy() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``most_bytes`` of text; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()], np.int64)
        piece = np.cumsum(lengths) // most_bytes
        starts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    tidy()


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    full = pa.compute.fill_null(array.cast(pa.large_string()), "")
    if full.offset:
        full = pa.concat_arrays([full, pa.array([], pa.large_string())])
    _, offsets, data = full.buffers()
    bounds = np.frombuffer(offsets, np.int64)[full.offset : full.offset + len(full) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def segment_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


PIECE = 50_000


class TokenTable(dict):
    """Numbers tokens in order of first sight and keeps one feature row for each.

    ``features(tokens)`` computes rows for new tokens only, so a token costs its
    evaluation once for each Python worker. Past ``most`` tokens the table is
    emptied and fills again: a bound on memory, not on what is computed. It is looked at
    before each ``PIECE`` tokens or one longer document.
    """

    def __init__(self, features: Callable[[list[str]], np.ndarray], width: int, most: int = 300_000):
        super().__init__()
        self.compute, self.most, self.new = features, most, []
        self.rows = np.zeros((0, width), np.float32)
        self.used = 0

    def __missing__(self, token: str) -> int:
        self[token] = place = len(self)
        self.new.append(token)
        return place

    def lookup(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of all tokens of all documents, and the token count of each."""
        counts = np.fromiter(map(len, documents), np.int64, len(documents))
        piece = np.cumsum(counts) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(documents)]
        parts = [self._rows(documents[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate(parts), counts

    def _rows(self, documents: list[list[str]]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.used, self.rows = 0, self.rows[:0]
        get = self.__getitem__
        places = np.fromiter(map(get, chain.from_iterable(documents)), np.int64)
        for start in range(0, len(self.new), 20_000):
            got = self.compute(self.new[start : start + 20_000])
            need = self.used + len(got)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.zeros((max(need, 2 * self.used) - self.used, self.rows.shape[1]), np.float32)])
            self.rows[self.used : need] = got
            self.used = need
        self.new = []
        return self.rows[places]


def bounded_sample(df: DataFrame, stratum: str, key: str, each: int, seed: int = 1, most_strata: int = 200) -> list:
    """Rows of a hash-ordered sample, at most ``each`` for every value of ``stratum``.

    The driver receives some ``most_strata * each`` rows. A null stratum is left out, and
    so are those past the ``most_strata`` most frequent ones (by name where even).
    """
    df = df.where(F.col(stratum).isNotNull())
    counts = {r[0]: r[1] for r in df.groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(most_strata).collect()}
    if not counts:
        return []
    order = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 30))
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * (1.25 * each + 20) / n)))])
    rows = df.where(order < F.element_at(limits, F.col(stratum))).withColumn("_order", order).orderBy("_order", F.col(key).cast("string")).limit(len(counts) * (2 * each + 100)).collect()
    taken: dict = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["_order"], str(r[key]))):
        taken[r[stratum]] = taken.get(r[stratum], 0) + 1
        if taken[r[stratum]] <= each:
            out.append(r)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: dict[int, int], seed: int, most_chars: int | None = None) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of labelled rows, at most ``most[class]`` of either class.

    A document with several label rows counts as the larger label. The chosen ids are
    as many numbers at most and are broadcast to the scan of the texts.

    ``most_chars`` bounds the characters of either class that come to the driver. Where the
    chosen texts are longer together, class 1 gives its shortest texts whole, as what marks
    them may stand anywhere (or the beginning of the shortest, if that alone is longer).
    Any part of a text of class 0 is of class 0, so all its texts give their beginnings,
    joined to texts as long as those of class 1.
    """
    spark = docs.sparkSession
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where(learn)
    chosen = [(r["doc_id"], r["label"]) for r in bounded_sample(own, "label", "doc_id", max(most.values()), seed)]
    chosen = [x for k in (0, 1) for x in [c for c in chosen if c[1] == k][: most[k]]]
    if not chosen:
        return []
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id long, label int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    rows = texts.join(ids, "doc_id")
    if most_chars is not None:
        sizes = rows.groupBy("doc_id", "label", F.length("text").alias("chars")).count().limit(4 * sum(most.values())).collect()
        wanted = within(sorted((r["label"], r["chars"], r["doc_id"], r["count"]) for r in sizes), most_chars)
        if not wanted:
            return []
        taken = F.broadcast(spark.createDataFrame(wanted, "label int, chars int, doc_id long, take int"))
        rows = texts.withColumn("chars", F.length("text")).join(taken, ["doc_id", "chars"]).select(F.expr("substring(text, 1, take)").alias("text"), "label")
    got = sorted((r["text"], r["label"]) for r in rows.limit(4 * sum(most.values())).collect())
    if most_chars is not None and any(x[0] == 0 and x[3] < x[1] for x in wanted):
        marked, plain = [t for t, y in got if y], [t for t, y in got if not y]
        many = max(1, min(len(plain), len(marked) * sum(map(len, plain)) // max(1, sum(map(len, marked)))))
        got = sorted([("\n".join(plain[k::many]), 0) for k in range(many)] + [(t, 1) for t in marked])
    return got


def within(sizes: list[tuple[int, int, int, int]], most_chars: int) -> list[tuple[int, int, int, int]]:
    """(label, chars, doc_id, chars to take) of ``most_chars`` characters a label at most, from sorted (label, chars, doc_id, rows)."""
    out: list[tuple[int, int, int, int]] = []
    # the same most of every text of label 0
    own = [x for x in sizes if x[0] == 0]
    left, rows = most_chars, sum(x[3] for x in own)
    for label, chars, doc_id, count in own:
        take = min(chars, left // rows)
        out.append((label, chars, doc_id, take))
        left, rows = left - take * count, rows - count
    # the shortest texts of label 1
    own, left, got = [x for x in sizes if x[0] == 1], most_chars, len(out)
    for label, chars, doc_id, count in own:
        if chars * count <= left:
            out.append((label, chars, doc_id, chars))
            left -= chars * count
    if own and not any(x[1] for x in out[got:]):  # nothing with text fits
        label, chars, doc_id, count = next((x for x in own if x[1]), own[0])
        out.append((label, chars, doc_id, min(chars, most_chars // count)))
    return out


def filter_texts(docs: DataFrame, judge: Callable[[], Callable[[list[str]], list[bool]]], most_bytes: int = 8 << 20) -> DataFrame:
    """The rows whose text passes, with all columns as they are; a map over the scan.

    ``judge`` makes the test once a task; it gets the texts of a slice, null as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = judge()
        for batch in text_slices(batches, "text", most_bytes):
            yield batch.filter(pa.array(passes(strings(batch.column("text"))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
