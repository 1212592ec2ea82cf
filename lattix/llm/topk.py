"""Exact top-k by inner product with a pivot table.

Components are floor(64 x) as integers. A bounded set of vectors serves as pivots;
the table keeps every vector's distances to all of them. By the triangle inequality
``|d(q, p) - d(v, p)|`` is at most ``d(q, v)`` for every pivot p, so the largest such
difference is a lower bound on the distance, and ``(|q|^2 + |v|^2 - bound^2) / 2`` an
upper bound on the score. Candidates are evaluated in the order of that bound, for a
tile of queries together, and the rest is left as soon as no bound reaches the k-th
score found by any of them.

Vectors are dealt to blocks by the hash of id and content, so copies spread; queries
are dealt to groups of bounded size and go to every block (the stated query set
against all rows, in blocks). Each task holds one block and one group. First every
query is scored against a bounded common sample; the k-th of those scores starts the
elimination in all blocks. The best k of each block meet per query at the end.

Defined results: vectors that are null, or hold null or non-finite components, take
no part; vectors whose length differs from the query's are no candidates; ties go to
the smaller vec_id; a repeated row is a candidate as often as it appears, and a query
row never meets itself but meets other rows with its id (rows are numbered in a table
written once); null ids take no part; with fewer than k candidates all are returned;
scores are exact, and one that no long holds raises an error; an empty table gives an
empty result; only id and vector are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SCHEMA = "query_row long, query_id long, vec_id long, score long, evaluated long"


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, 64 times its vector and a number that tells equal rows apart, without the rows that take no part."""
    x = F.col("embedding")
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x)
    limit = F.lit(float("inf"))
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < limit), F.lit(False)))
    vectors = F.transform(x, lambda c: F.lit(64.0) * c.cast("double"))  # rounded down where they are read
    return plain.where(usable).select("vec_id", vectors.alias("vector"), F.monotonically_increasing_id().alias("row"))


class PivotTable:
    """Vectors of one dimension with their distances to the pivots.

    Queries go in tiles. Bounds are in single precision with room for its rounding;
    scores are exact.
    """

    TILE, FIRST, STEP = 64, 256, 2_048

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.pivots = pivots
        self.square = (vectors.astype(np.float64) ** 2).sum(1)
        self.table = np.ascontiguousarray(distances(vectors, pivots).T.astype(np.float32))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds on the scores of all vectors for every query."""
        near = distances(queries, self.pivots).astype(np.float32)
        square = (queries.astype(np.float64) ** 2).sum(1)
        out = np.empty((len(queries), len(self.ids)), np.float32)
        for start in range(0, len(self.ids), 4_096):  # parts that stay in the cache
            part = slice(start, start + 4_096)
            low = np.zeros((len(queries), len(self.ids[part])), np.float32)
            gap = np.empty_like(low)
            for p, to in enumerate(self.table):
                np.subtract(to[part][None, :], near[:, p, None], out=gap)
                np.abs(gap, out=gap)
                np.maximum(low, gap, out=low)
            both = (square[:, None] + self.square[None, part]).astype(np.float32)
            low *= np.float32(1 - 1e-5)
            low -= np.float32(1e-4) * np.sqrt(both)
            np.maximum(low, 0, out=low)
            out[:, part] = (both - low * low) * np.float32(0.5) + both * np.float32(1e-5) + 1
        return np.where(np.isnan(out), np.float32(np.inf), out)  # beyond single precision: no bound

    def top(self, query_rows: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
        """For each query its k best (score, id) and how many vectors were evaluated.

        ``floors`` are scores that k vectors are known to reach; they rise as scores are found.
        """
        out = []
        for at in range(0, len(queries), self.TILE):
            out += self._tile(query_rows[at : at + self.TILE], queries[at : at + self.TILE], k, floors[at : at + self.TILE].astype(np.float64))
        return out

    def _tile(self, query_rows: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
        bound = self.bounds(queries)
        start = np.where(np.isfinite(floors), floors, 0.0)
        above = (bound - start[:, None]).max(0) if len(bound) else np.zeros(len(self.ids))
        order = np.argsort(-above, kind="stable")
        done = np.zeros(len(queries), np.int64)
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        at = end = 0
        while end < len(order):
            at, end = end, end + min(self.STEP, max(self.FIRST, end))
            # no later vector's bound is further above any query's floor than this one's was at the start
            if above[order[at]] < (floors - start).min():
                break
            some = order[at:end]
            open_ = bound[:, some] >= floors[:, None]
            if not open_.any():
                continue
            scores = dot(self.vectors[some], queries.T).T
            done += open_.sum(1)
            hit = open_ & (scores >= floors[:, None]) & (self.rows[some][None, :] != query_rows[:, None])
            for q in np.flatnonzero(hit.any(1)).tolist():
                places = np.flatnonzero(hit[q])
                if len(places) > 4 * k:  # those below the k-th highest are out, but for ties
                    least = np.partition(scores[q, places], len(places) - k)[len(places) - k]
                    places = places[scores[q, places] >= least]
                best[q] = sorted(best[q] + list(zip((-scores[q, places]).tolist(), self.ids[some[places]].tolist(), strict=True)))[:k]
                if len(best[q]) == k:
                    floors[q] = max(floors[q], -best[q][-1][0])
        return [([(-s, i) for s, i in b], int(d)) for b, d in zip(best, done, strict=True)]


def dot(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products (with one query, or queries as columns): in floating point where no sum leaves its exact range."""
    top = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    for kind, most in ((np.float32, 1 << 24), (np.float64, 1 << 52)):
        if top < most:
            return (vectors.astype(kind) @ query.astype(kind)).astype(np.int64)
    whole = lambda x: np.array([int(c) for c in x.ravel()], object).reshape(x.shape)
    exact = whole(vectors) @ whole(query)
    if any(not -(1 << 63) <= c < 1 << 63 for c in np.ravel(exact)):
        raise OverflowError("a score is beyond the range of a long")
    return exact.astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances from the differences themselves, without cancellation."""
    out = np.zeros((len(a), len(b)))
    for j in range(len(b)):
        out[:, j] = np.sqrt(((a - b[j]).astype(np.float64) ** 2).sum(1))
    return out


def choose_pivots(vectors: np.ndarray, most: int) -> np.ndarray:
    """Far-apart vectors: each the farthest from those chosen before."""
    if not len(vectors):
        return vectors
    chosen = [0]
    near = distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


Vectors = tuple[np.ndarray, np.ndarray, np.ndarray]


def by_dimension(rows: pa.Array, ids: pa.Array, vectors: pa.Array) -> dict[int, Vectors]:
    """Row numbers, ids and vectors as arrays, by the vectors' length."""
    size = np.asarray(pa.compute.list_value_length(vectors)).astype(np.int64)
    row, key = np.asarray(rows), np.asarray(ids)
    flat, ends = np.floor(np.asarray(vectors.flatten()).astype(np.float64)), np.cumsum(size)
    out = {}
    for d in np.unique(size).tolist():
        mine = np.flatnonzero(size == d)
        out[d] = (row[mine], key[mine], flat[(ends[mine] - d)[:, None] + np.arange(d)[None, :]])
    return out


def search(embeddings: DataFrame, is_query, k: int = 20, pivots: int = 32, sample: int = 2_000, block_rows: int = 20_000, group_rows: int = 10_000) -> DataFrame:
    """The ``k`` best candidates of every row that ``is_query`` marks.

    ``sample`` bounds the vectors that are sent to all tasks (pivots are chosen from
    them); ``block_rows`` and ``group_rows`` set the mean sizes of a block and a group.
    """
    vectors = materialize(integers(embeddings).withColumn("query", is_query), "vectors")
    total = vectors.count()
    blocks = max(1, -(-total // block_rows))
    queries = vectors.where("query").count()
    groups = max(1, -(-queries // group_rows))
    dealt = F.xxhash64("vec_id", "vector", "row")
    rate = min(1.0, 1.5 * sample / max(1, total))
    picked = vectors.where(F.pmod(F.xxhash64(F.lit(7), "vec_id", "vector", "row"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).limit(sample)
    got = picked.select("row", "vec_id", "vector").toArrow().combine_chunks()
    common = by_dimension(*(c.combine_chunks() for c in got.columns)) if got.num_rows else {}
    common = {d: (rows, ids, v, choose_pivots(v, pivots)) for d, (rows, ids, v) in common.items()}
    shared = embeddings.sparkSession.sparkContext.broadcast(common)  # at most `sample` vectors and their pivots

    # one row for each (group, block) a vector is needed in
    as_candidate = vectors.select("row", "vec_id", "vector", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"))
    as_query = vectors.where("query").select("row", "vec_id", "vector", F.lit(True).alias("asks"), F.pmod(dealt, F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        asks = table.column("asks")
        sides = []
        for side in (asks, pa.compute.invert(asks)):
            some = table.filter(side).combine_chunks()
            sides.append(by_dimension(*(some.column(c).combine_chunks() for c in ("row", "vec_id", "vector"))) if some.num_rows else {})
        asking, having = sides
        out: list[tuple[int, int, int, int, int]] = []
        for d, (rows, ids, v) in asking.items():
            if d not in having:
                continue
            known = shared.value.get(d)
            pivots_table = PivotTable(*having[d], known[3] if known is not None else v[:0])
            floors = np.full(len(v), -np.inf)
            if known is not None:
                for at in range(0, len(v), 256):
                    score = dot(known[2], v[at : at + 256].T).T.astype(np.float64)
                    score[known[0][None, :] == rows[at : at + 256, None]] = -np.inf
                    if score.shape[1] >= k:
                        floors[at : at + 256] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            for i, (best, done) in enumerate(pivots_table.top(rows, v, k, floors)):
                out += [(int(rows[i]), int(ids[i]), c, s, done) for s, c in best]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score", "evaluated"])

    found = as_candidate.unionByName(as_query).groupBy("group", "block").applyInArrow(run, SCHEMA)
    place = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
