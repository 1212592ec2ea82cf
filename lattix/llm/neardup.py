"""Near-duplicate classes by ProbMinHash.

A document is its five-word shingles weighted by how often they occur. Every shingle
is a Poisson process whose rate is its weight; each arrival falls into one of 120
registers, and a register keeps the shingle that arrives first. A document stops when
no further arrival can come before the last register's. The share of registers that
agree estimates the probability Jaccard similarity, which for equal weights is the
usual Jaccard similarity. 24 bands of 5 registers give the candidates, and candidates
are verified by the exact probability Jaccard similarity, 0.8 or more.

Exact copies (equal words) collapse first, so a group of copies is one node. In a
bucket every node is first verified against one leader: the node whose buckets hold the
most nodes in all, which near copies of one text have in common. Buckets whose nodes
are then in one component are done. In all others every pair of nodes of different
components is verified, whatever their number: a bucket is dealt to parts of bounded
size, one task for each two parts, and pairs are compared within the task, in numpy, so
only links leave it. A pair is verified in the first bucket it shares. A node goes no
further in a part where the shingles that any other node has make up less than 0.8 of
its weight. So no pair that shares a bucket is left out; a pair at a similarity of 0.8
shares none with probability (1 - 0.8 ** 5) ** 24, 0.00007. Work between components of
one bucket grows with the product of their sizes; rows do so only by part.

Defined results: words are runs of ASCII letters and digits and of all other
non-ASCII characters, in lower case; one to four words form one shingle; a text
without a word is a copy of equal texts only; null and empty texts are alone in
their class (null or empty ids too). The class id is the smallest doc_id of the class.
Repeated rows are copies. An empty table gives an empty result. Only id and text are
read, so other columns' names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_slot, materialize, text_bytes, text_slices
from .components import components

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
REGISTERS = BANDS * ROWS
SLICE = 2 << 20  # bytes of text at a time; hashing takes some forty times as much memory
ID_BITS = 50
ID_MASK = np.uint64((1 << ID_BITS) - 1)
MOST_ROWS = 1 << (64 - ID_BITS)

_bytes = np.arange(256)
IN_WORD = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
OF_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)
P = np.uint64(0x9E3779B97F4A7C15)
A = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the word count of each text."""
    raw, bounds = text_bytes(pc.utf8_lower(array.cast(pa.large_string())))
    docs = len(bounds) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    inside = IN_WORD[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(raw)]
    start[firsts] = inside[firsts]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    counts = np.diff(np.searchsorted(at, bounds))
    ordinal = np.cumsum(start) - 1
    place = np.arange(len(raw)) - at[np.maximum(ordinal, 0)]
    place[~inside] = 0
    powers = np.ones(int(place.max()) + 1, np.uint64)
    powers[1:] = P
    powers = np.cumprod(powers)
    value = np.where(inside, OF_BYTE[raw] * powers[place], np.uint64(0))
    return mix(np.add.reduceat(value, at)), counts


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted: their 50-bit numbers, how often they occur, and how many a text has."""
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1)))
    long = counts >= WORDS
    n = np.where(long, counts - WORDS + 1, 0)
    first = np.repeat(ends - counts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    h = words[first] if len(first) else np.zeros(0, np.uint64)
    for k in range(1, WORDS):
        h = h * A + words[first + k]
    number = np.zeros(len(doc), np.uint64)
    is_long = np.repeat(long, np.where(long, n, np.minimum(counts, 1)))
    number[is_long] = mix(h)
    short = np.flatnonzero(~long & (counts > 0))
    number[~is_long] = mix(np.array([_join(words[ends[i] - counts[i] : ends[i]]) for i in short], np.uint64))
    key = np.sort(doc << np.uint64(ID_BITS) | number >> np.uint64(64 - ID_BITS))
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(key)])
    key = key[at]
    return key & ID_MASK, times.astype(np.float64), np.bincount((key >> np.uint64(ID_BITS)).astype(np.int64), minlength=len(counts))


def _join(words: np.ndarray) -> int:
    h = 0x5BD1E995 + len(words)
    for w in words.tolist():
        h = (h * int(A) + w) & 0xFFFFFFFFFFFFFFFF
    return h


def sketches(numbers: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Texts x registers: the shingle that arrives first; texts without a shingle are rows of 0.

    Arrivals of all shingles of all texts go forward together. A text with few
    shingles takes several arrivals of each at once.
    """
    docs = len(counts)
    time = np.full(docs * REGISTERS, np.inf)
    owner = np.zeros(docs * REGISTERS, np.uint64)
    doc = np.repeat(np.arange(docs), counts)
    number, rate, clock = numbers, weights, np.zeros(len(numbers))
    drawn = np.zeros(len(numbers), np.int64)
    seed = mix(number * P + np.uint64(1))
    while len(number):
        live = np.bincount(doc, minlength=docs)
        many = np.clip(2 * REGISTERS // np.maximum(live, 1), 1, 64)[doc]
        e = np.repeat(np.arange(len(number)), many)
        first = np.cumsum(many) - many
        k = np.arange(len(e)) - first[e]
        draw = mix(seed[e] + (drawn[e] + k).astype(np.uint64) * P)
        unit = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        gap = -np.log(unit) / rate[e]
        total = np.cumsum(gap)
        at = clock[e] + total - (total[first] - gap[first])[e]
        register = (mix(draw ^ A) % np.uint64(REGISTERS)).astype(np.int64) + doc[e] * REGISTERS
        early = at < time[register]
        at_e, reg_e, num_e = at[early], register[early], number[e[early]]
        np.minimum.at(time, reg_e, at_e)
        won = time[reg_e] == at_e
        owner[reg_e[won]] = num_e[won]
        last = first + many - 1
        clock, drawn = at[last], drawn + many
        limit = np.zeros(docs)
        present = np.unique(doc)
        limit[present] = time.reshape(docs, REGISTERS)[present].max(1)
        go = clock < limit[doc]
        number, rate, clock, drawn, doc, seed = number[go], rate[go], clock[go], drawn[go], doc[go], seed[go]
    return owner.reshape(docs, REGISTERS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Texts x bands: one number for the registers of each band, different by band."""
    out = np.empty((len(sketch), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sketch), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * A + sketch[:, b * ROWS + r])
        out[:, b] = h
    return out.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact: the sum over common i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    (na, wa), (nb, wb) = a, b
    if not len(na) or not len(nb):
        return 0.0
    every = np.union1d(na, nb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, na)] = wa
    y[np.searchsorted(every, nb)] = wb
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    xs, ys, r = x[order], y[order], ratio[order]
    low_x = np.concatenate([[0], np.cumsum(xs)])
    high_y = ys.sum() - np.concatenate([[0], np.cumsum(ys)])
    mine = ratio[both]
    split = np.searchsorted(r, mine, "right")
    # j with a smaller or equal ratio contribute x_j / x_i, the others y_j / y_i
    return float((1 / (low_x[split] / x[both] + high_y[split] / y[both])).sum())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free_slot()
    for big in text_slices(batches, "text", SLICE):
        for start in range(0, big.num_rows, MOST_ROWS):
            batch = big.slice(start, MOST_ROWS)
            text = batch.column("text")
            words, counts = word_hashes(text)
            numbers, weights, many = shingles(words, counts)
            bands = band_keys(sketches(numbers, weights, many))
            ends = np.cumsum(counts)
            raw = text.to_pylist()
            keys = [
                hashlib.blake2b(words[e - n : e].tobytes(), digest_size=16).digest() if n else hashlib.blake2b(b"text" + t.encode(), digest_size=16).digest() if t else None
                for t, n, e in zip(raw, counts.tolist(), ends.tolist(), strict=True)
            ]
            has = many > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[has].ravel()))], names=["doc_id", "text_hash", "key", "bands"])


PART = 1_000  # nodes of a bucket in one part
PART_SHINGLES = 1 << 20  # or so many shingles
LEADER_PART = 2_000  # pairs with one leader in one task
SLACK = 1e-9  # for rounding in sums of shares
SHINGLED = "node long, numbers array<long>, times array<int>"


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, sorted, and how often they occur (null: once each)."""
    free_slot()
    for big in text_slices(batches, "text", SLICE):
        for start in range(0, big.num_rows, MOST_ROWS):
            batch = big.slice(start, MOST_ROWS)
            numbers, weights, many = shingles(*word_hashes(batch.column("text")))
            ends = np.cumsum(many)
            repeats = np.add.reduceat(np.append(weights > 1, False), ends - many) * (many > 0) > 0
            mine = np.repeat(repeats, many)
            offsets = np.concatenate([[0], np.cumsum(np.where(repeats, many, 0))]).astype(np.int32)
            times = pa.ListArray.from_arrays(pa.array(offsets), pa.array(weights[mine].astype(np.int32)), mask=pa.array(~repeats))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(numbers.astype(np.int64))), times], names=["node", "numbers", "times"])


class Texts:
    """Shingles of several texts one after another, with their share of each text's weight."""

    def __init__(self, numbers: pa.Array, times: pa.Array):
        self.count = np.asarray(pc.list_value_length(numbers)).astype(np.int64)
        self.end = np.cumsum(self.count)
        self.number = np.asarray(numbers.flatten()).astype(np.uint64)
        self.weight = np.ones(len(self.number))
        self.plain = np.asarray(times.is_null())
        self.weight[np.repeat(~self.plain, self.count)] = np.asarray(times.flatten())
        total = np.bincount(self.owner(), self.weight, len(self.count))
        self.share = self.weight / np.repeat(total, self.count)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def pair(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.end[i] - self.count[i], self.end[i])
        return self.number[part], self.weight[part]


def _at_least(a: Texts, i: int, b: Texts, rows: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of the texts ``rows`` of ``b`` are similar enough to text ``i`` of ``a``.

    ``common`` are their sums of the smaller shares of common shingles, which no
    similarity exceeds. Texts without repeats are decided by the number of common
    shingles, which follows from that sum; the others by the full formula.
    """
    out = common >= SIMILARITY - SLACK
    counts = b.count[rows]
    if a.plain[i]:
        both = np.rint(common * np.maximum(counts, a.count[i]))
        plain = b.plain[rows]
        out &= ~plain | (both >= SIMILARITY * (a.count[i] + counts - both))
        doubtful = np.flatnonzero(out & ~plain)
    else:
        doubtful = np.flatnonzero(out)
    for k in doubtful.tolist():
        out[k] = probability_jaccard(a.pair(i), b.pair(rows[k])) >= SIMILARITY
    return out


def _with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of leaders with the nodes that follow them; ``role`` is 0 on a leader's own row."""
    leader: Texts | None = None
    for batch in batches:
        leaders, roles = np.asarray(batch.column("leader")), np.asarray(batch.column("role"))
        texts = Texts(batch.column("numbers"), batch.column("times"))
        nodes = np.asarray(batch.column("node"))
        cuts = np.flatnonzero(np.r_[True, roles[1:] == 0, True]) if len(roles) else []
        u, v = [], []
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            rows = np.arange(first, last)
            if roles[first] == 0:
                leader = Texts(batch.column("numbers").slice(first, 1), batch.column("times").slice(first, 1))
                rows = rows[1:]
            if not len(rows):
                continue
            part = slice(texts.end[rows[0]] - texts.count[rows[0]], texts.end[rows[-1]])
            at = np.minimum(np.searchsorted(leader.number, texts.number[part]), len(leader.number) - 1)
            low = np.where(leader.number[at] == texts.number[part], np.minimum(leader.share[at], texts.share[part]), 0.0)
            common = np.bincount(np.repeat(np.arange(len(rows)), texts.count[rows]), low, len(rows))
            good = rows[_at_least(leader, 0, texts, rows, common)]
            u.append(leaders[good])
            v.append(nodes[good])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (u, v)], names=["u", "v"])


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the components of one bucket, among one part of it or between two."""
    table = table.combine_chunks()
    bucket, two = table.column("bucket")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
    label = np.asarray(table.column("component")).copy()
    node, part = np.asarray(table.column("node")), np.asarray(table.column("part"))
    bands = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
    before = bands[:, : int(np.flatnonzero(bands[0] == bucket)[0])]
    texts = Texts(table.column("numbers").combine_chunks(), table.column("times").combine_chunks())
    _, ids, often = np.unique(texts.number, return_inverse=True, return_counts=True)
    shared = often[ids] > 1
    owner = texts.owner()
    possible = np.bincount(owner[shared], texts.share[shared], len(node)) >= SIMILARITY - SLACK
    keep = shared & possible[owner]
    ids, share = ids[keep], texts.share[keep]
    count = np.bincount(owner[keep], minlength=len(node))
    start = np.cumsum(count) - count
    mark = np.zeros(len(often))
    u, v = [], []
    rows = np.flatnonzero(possible)
    for at, i in enumerate(rows):
        rest = rows[at + 1 :]
        if two:
            rest = rest[part[rest] != part[i]]
        rest = rest[label[rest] != label[i]]
        if not len(rest):
            continue
        rest = rest[~(before[rest] == before[i]).any(1)]
        mine = slice(start[i], start[i] + count[i])
        mark[ids[mine]] = share[mine]
        for k in range(0, len(rest), 500):
            some = rest[k : k + 500]
            n = count[some]
            of = np.repeat(np.arange(len(some)), n)
            place = np.arange(len(of)) + np.repeat(start[some] - np.cumsum(n) + n, n)
            common = np.bincount(of, np.minimum(mark[ids[place]], share[place]), len(some))
            for j in some[_at_least(texts, i, texts, some, common)].tolist():
                if label[j] != label[i]:
                    u.append(node[i])
                    v.append(node[j])
                    label[label == label[j]] = label[i]
        mark[ids[mine]] = 0
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _leader_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among (leader, node), as a written table. A leader's shingles go out once for each ``LEADER_PART`` of its pairs."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / LEADER_PART).cast("int").alias("salts"))
    nodes = pairs.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "node")
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("leader").alias("node"))
    rows = nodes.unionByName(heads).join(texts, "node").select("leader", "salt", "role", "node", "numbers", "times")
    dealt = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role")
    return materialize(dealt.mapInArrow(_with_leader, "u long, v long"), "links")


def _rest_links(members: DataFrame, bands: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """Links among all pairs of different components of a bucket, as a written table."""
    placed = members.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    weight = F.greatest(F.lit(1.0 / PART), F.col("size") / F.lit(PART_SHINGLES))
    placed = placed.join(texts.select("node", F.size("numbers").alias("size")), "node")
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.ceil(F.sum(weight)).cast("int").alias("parts")).where("least != most").select("bucket", "parts")
    dealt = placed.join(open_, "bucket").withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "component")
    full = dealt.join(texts.join(bands, "node"), "node")
    return materialize(full.groupBy("bucket", "i", "j").applyInArrow(_block_links, "u long, v long").distinct(), "links")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, class_id, class_text_hash`` for every row of ``docs``.

    The last two name the document that represents the class.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("text_hash", F.xxhash64("text"))
    signed = materialize(source.mapInArrow(_signatures, "doc_id long, text_hash long, key binary, bands array<long>"), "signatures")
    # one node for each distinct word sequence; its document is the smallest id
    nodes = signed.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("own"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "own.doc_id", "own.text_hash", "bands"), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    members = materialize(spread.join(buckets, "bucket"), "members")
    central = members.groupBy("node").agg(F.sum("many").alias("central"))
    leaders = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", (-F.col("node")).alias("least"))).alias("top")).select("bucket", (-F.col("top.least")).alias("leader"))
    pairs = materialize(members.join(leaders, "bucket").where("node != leader").select("leader", "node").distinct(), "pairs")
    wanted = nodes.join(central, "node", "left_semi").select("node", "doc_id", "text_hash")
    texts = wanted.join(source.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), (F.col("h") == F.col("text_hash")) & F.col("d").eqNullSafe(F.col("doc_id"))).groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts.mapInArrow(_shingled, SHINGLED), "shingles")
    links = _leader_links(pairs, texts)
    first = components(links)
    more = _rest_links(members, nodes.select("node", "bands"), texts, first)
    found = components(links.unionAll(more)) if more.limit(1).count() else first
    named = nodes.select("node", "key", "doc_id", "text_hash").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("head"))
    by_key = materialize(named.join(heads, "component").select("key", F.col("head.doc_id").alias("class_id"), F.col("head.text_hash").alias("class_text_hash")), "classes")
    for table in (members, pairs, texts, links, more, nodes):
        discard(table)
    alone = signed.where("key is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("text_hash").alias("class_text_hash"))
    return signed.where("key is not null").join(by_key, "key").select("doc_id", "text_hash", "class_id", "class_text_hash").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, with all columns.

    Rows are found again by id and content. Equal rows of one id are told apart only
    where there are some.
    """
    found = classes(docs)
    mine = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_text_hash"))
    kept = materialize(found.where(mine).groupBy("doc_id", "text_hash").agg(F.count("*").alias("times")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "times"), "kept")
    content = F.coalesce(F.col("text"), F.lit(""))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(content) == F.col("_hash"))
    names = docs.columns
    single = docs.join(kept.where("times = 1"), same, "left_semi")
    # empty texts are classes of their own, whatever their number
    empty = F.length(content) == 0
    if kept.where("times > 1").limit(1).count():
        repeated = docs.join(kept.where("times > 1"), same, "left_semi")
        once = repeated.where(~empty).withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).select(*names)
        return single.unionByName(once).unionByName(repeated.where(empty))
    return single


