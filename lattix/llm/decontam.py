"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Texts are normalised to lower-case UTF-8 bytes with every run of ASCII characters
that are no letters or digits as one space. A document contains an item if some part
of it lies within ``rate`` (a tenth) of the item's length in edits.

A CGK walk reads a window from an anchor on: at each step it puts out the byte it
stands on and moves on or stays, as a random bit for this step and byte says, so that
after an edit two walks soon meet again and their outputs differ in few places. Each of
``TABLES`` walks has a hash table: some of its outputs, sampled once, are the key. Items
of all sizes are embedded in parts: anchors are the starts of words (and, within long
runs without a space, places chosen by the bytes there), the same in items and
documents. At a tenth in edits an anchor of an occurrence meets its item's in some table
with a probability of about 0.5. An item-sized window is a candidate where at least
``needed`` of the item's anchors meet on about one diagonal; that number is chosen by
the item's count of anchors so that an occurrence has as many but for a probability of
0.001 at 0.38 an anchor. Candidates that hold too few of the item's runs of four bytes
to lie within its edits (each edit changes four at most) are out; all others are verified
by an exact edit distance (bit-parallel) over the window and its margins, near ones
together.

Items with fewer than ``FEW`` anchors are too short for that (some 70 bytes); they are
found by pieces of which an occurrence must hold one unchanged, and verified likewise.

Items go out in blocks of bounded size, one pass over the documents for each; a
document is never cut. No shuffle takes place.

Defined results: items of null, empty or letterless text match nothing, items of a
null id match like others, null and empty texts contain nothing; items of equal text
are all reported, an item row repeated with its id once; an item of a few bytes needs
to occur unchanged when a tenth of its length is less than one edit; repeated document
rows repeat; the smallest distance of an item wins, ties go to the earliest place; very
long texts are read whole; empty tables give an empty result; only ids and texts are
read, so other columns' names cannot clash.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, strings, text_slices, worker_slot

SLICE = 4 << 20  # bytes of text at a time
SCHEMA = "doc_id long, item_id long, distance int, item_bytes int, at long"
_plain = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text: str) -> str:
    """Normalised UTF-8 bytes, one character a byte."""
    return b" ".join(text.lower().encode().translate(_plain).split()).decode("latin-1")


def edits_allowed(size: int, rate: float) -> int:
    return int(size * rate)


def best_match(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``item`` to any part of ``text``, and where that part ends first.

    A column of the distance table is two bit vectors (Myers 1999), as whole numbers.
    """
    m = len(item)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full  # 0 enters above: a match may start anywhere
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if score < best:
            best, at = score, j + 1
    return best, at


def best_match_reference(item: str, text: str) -> int:
    """The same distance by the plain table."""
    above = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        row = [i + 1]
        for j, b in enumerate(text):
            row.append(min(above[j] + (a != b), above[j + 1] + 1, row[-1] + 1))
        above = row
    return min(above)


TABLES, STEPS, SAMPLED, FEW = 4, 32, 14, 10
PAD = bytes(STEPS + 4)
MIX = np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(77)
MOVES = _draw.integers(0, 2, (TABLES, STEPS, 256))  # whether a walk moves on, by step and byte
PLACES = [frozenset(_draw.choice(STEPS, SAMPLED, replace=False).tolist()) for _ in range(TABLES)]
FILTER_BITS = 22
GRAM, GRAM_BITS = 4, 14


def anchors(data: np.ndarray) -> np.ndarray:
    """Starts of words, and places at 8 bytes and more into a word that its own bytes choose (about a third)."""
    inside = (data != 32) & (data != 0)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    place = np.arange(len(data), dtype=np.int32)
    deep = np.flatnonzero(inside & (place - np.maximum.accumulate(np.where(start, place, 0)) >= 8))
    deep = deep[deep < len(data) - 2]
    mixed = data[deep].astype(np.uint32) * 31 + data[deep + 1].astype(np.uint32) * 17 + data[deep + 2].astype(np.uint32) * 7
    start[deep[mixed % 3 == 0]] = True
    return np.flatnonzero(start)


def walks(data: np.ndarray, at: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the walk from every place, and where each walk ends. ``data`` reaches ``STEPS`` beyond all places."""
    keys, ends = np.empty(len(at), np.uint64), np.empty(len(at), np.int64)
    for k in range(0, len(at), 1 << 14):  # parts that stay in the cache
        place = at[k : k + (1 << 14)].astype(np.int64)
        key = np.full(len(place), table + 1, np.uint64)
        byte, move = np.empty(len(place), np.uint8), np.empty(len(place), np.int64)
        for step in range(STEPS):
            np.take(data, place, out=byte, mode="clip")
            if step in PLACES[table]:
                key *= MIX
                key += byte
            np.take(MOVES[table, step], byte, out=move, mode="clip")
            place += move
        keys[k : k + len(place)], ends[k : k + len(place)] = (key ^ key >> np.uint64(31)) * MIX, place
    return keys, ends


def grams(data: np.ndarray) -> np.ndarray:
    """Small hashes of all runs of ``GRAM`` bytes."""
    wide = data.astype(np.uint32)
    out = np.zeros(max(0, len(data) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        out = out * np.uint32(0x9E3779B1) + wide[k : k + len(out)]
    return (out * np.uint32(0x85EBCA6B) >> np.uint32(32 - GRAM_BITS)).astype(np.uint16)


def needed(many: int) -> int:
    """The most anchors that at least so many of ``many`` meet but for a probability of 0.001, at 0.38 each."""
    below, term = 0.0, 0.62**many
    for h in range(many):
        below += term
        if below > 0.001:
            return max(1, h)
        term *= (many - h) / (h + 1) * 0.38 / 0.62
    return max(1, many)


@dataclass
class ItemIndex:
    """One bounded block of items, ready for search."""

    items: list[tuple[list[int | None], str]]  # ids and normalised text
    rate: float

    def __post_init__(self):
        data = np.frombuffer(b"".join(t.encode("latin-1") + PAD for _, t in self.items), np.uint8)
        size = np.array([len(t) for _, t in self.items], np.int64)
        first = np.cumsum(size + len(PAD)) - size - len(PAD)
        self.allowed = np.array([edits_allowed(n, self.rate) for n in size.tolist()], np.int64)
        at = anchors(data) if len(data) else np.zeros(0, np.int64)
        item = np.searchsorted(first, at, "right") - 1
        usable = np.zeros(len(at), bool)
        tables = []
        for t in range(TABLES):
            keys, ends = walks(data, at, t)
            own = ends <= first[item] + size[item]  # a walk that leaves the item reads what a document has there
            usable |= own
            tables.append((keys, own))
        many = np.bincount(item[usable], minlength=len(size))
        walked = many >= FEW
        self.need = np.array([needed(n) for n in many.tolist()], np.int64)
        keys = np.concatenate([k[own & walked[item]] for k, own in tables])
        item_of = np.concatenate([item[own & walked[item]] for _, own in tables])
        place_of = np.concatenate([(at - first[item])[own & walked[item]] for _, own in tables])
        order = np.argsort(keys, kind="stable")
        self.key, self.item, self.place = keys[order], item_of[order], place_of[order]
        cut = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(self.key) else np.zeros(0, np.int64)
        self.same = np.zeros(len(self.key), np.int64)
        self.same[cut] = np.diff(np.r_[cut, len(self.key)])  # how many items' places have a key, where it starts
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.key >> np.uint64(64 - FILTER_BITS)] = True
        self.gram_sets: dict[int, np.ndarray] = {}
        self.automaton = None
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(~walked).tolist():
            text = self.items[k][1]
            parts = min(len(text), int(self.allowed[k]) + 1)
            cuts = [round(i * len(text) / parts) for i in range(parts + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(text[a:b], []).append((k, a))
        if pieces:
            self.automaton = ahocorasick.Automaton()
            for piece, where in pieces.items():
                self.automaton.add_word(piece, (len(piece), where))
            self.automaton.make_automaton()

    def item_grams(self, k: int) -> np.ndarray:
        """Which hashes of runs of bytes an item has."""
        got = self.gram_sets.get(k)
        if got is None:
            if len(self.gram_sets) >= 2_000:
                self.gram_sets.clear()
            got = np.zeros(1 << GRAM_BITS, bool)
            got[grams(np.frombuffer(self.items[k][1].encode("latin-1"), np.uint8))] = True
            self.gram_sets[k] = got
        return got

    def meetings(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and diagonal of all anchors that meet in a table, once each, where a text and an item have enough."""
        at = anchors(data)
        text_of = np.searchsorted(first, at, "right") - 1
        found = []
        for t in range(TABLES):
            keys, _ = walks(data, at, t)
            some = np.flatnonzero(self.filter[keys >> np.uint64(64 - FILTER_BITS)])
            lo = np.searchsorted(self.key, keys[some], "left")
            hit = self.key[np.minimum(lo, len(self.key) - 1)] == keys[some]
            some, lo = some[hit], lo[hit]
            n = self.same[lo]
            where = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            found.append((np.repeat(some, n), where))
        some, where = (np.concatenate(x) for x in zip(*found, strict=True))
        text, item = text_of[some], self.item[where]
        # texts and items by a number that several may share: a bound on what they have
        pair = (text * 0x9E3779B1 + item * 0x85EBCA6B >> 8) & 0xFFFFF
        keep = np.bincount(pair, minlength=1 << 20)[pair] >= self.need[item]
        some, text, item, inner = some[keep], text[keep], item[keep], self.place[where[keep]]
        diagonal = at[some] - first[text] - inner
        order = np.lexsort((inner, diagonal, item, text))
        text, item, diagonal, inner = text[order], item[order], diagonal[order], inner[order]
        new = np.ones(len(text), bool)
        for k, x in enumerate((text, item, diagonal, inner)):
            new[1:] = (x[1:] != x[:-1]) if k == 0 else new[1:] | (x[1:] != x[:-1])
        return text[new], item[new], diagonal[new]

    def windows(self, plain: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, diagonal) wherever enough anchors of the item meet within its allowed edits."""
        if not len(self.key):
            return []
        size = np.array([len(t) for t in plain], np.int64)
        first = np.cumsum(size + len(PAD)) - size - len(PAD)
        text, item, diagonal = self.meetings(np.frombuffer(b"".join(t + PAD for t in plain), np.uint8), first)
        need, reach = self.need[item], self.allowed[item]
        # the place of the meeting that is need - 1 further on, if it is one of the same text and item
        last = np.arange(len(text)) + need - 1
        ok = last < len(text)
        ok[ok] &= (text[last[ok]] == text[ok]) & (item[last[ok]] == item[ok]) & (diagonal[last[ok]] - diagonal[ok] <= reach[ok])
        opens = np.zeros(len(text) + 1, np.int64)
        np.add.at(opens, np.flatnonzero(ok), 1)
        np.add.at(opens, last[ok] + 1, -1)
        use = np.cumsum(opens[:-1]) > 0
        return list(zip(text[use].tolist(), item[use].tolist(), diagonal[use].tolist(), strict=True))

    def short_windows(self, plain: list[bytes]) -> list[tuple[int, int, int]]:
        """The same for short items, wherever a piece of one stands."""
        if self.automaton is None:
            return []
        out = []
        for i, text in enumerate(plain):
            for end, (size, where) in self.automaton.iter(text.decode("latin-1")):
                out += [(i, k, end + 1 - size - offset) for k, offset in where]
        return out

    def search(self, texts: list[str]) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item id, distance, item's bytes, place) of every item that a text contains."""
        plain = [normalise(t).encode("latin-1") for t in texts]
        found: dict[tuple[int, int], set[int]] = {}
        for i, k, d in self.windows(plain) + self.short_windows(plain):
            found.setdefault((i, k), set()).add(max(0, d))
        out = []
        of = None
        for (i, k), starts in sorted(found.items()):
            ids, item = self.items[k]
            allowed = int(self.allowed[k])
            if i != of:
                of, own_grams = i, grams(np.frombuffer(plain[i], np.uint8))
            known = self.item_grams(k)
            least = len(item) - GRAM + 1 - GRAM * allowed
            best: tuple[int, int] | None = None
            spans: list[list[int]] = []
            for start in sorted(starts):  # windows that overlap by their margins are verified together
                if spans and start - 2 * allowed <= spans[-1][1]:
                    spans[-1][1] = start + len(item) + 2 * allowed
                else:
                    spans.append([max(0, start - 2 * allowed), start + len(item) + 2 * allowed])
            for first, last in spans:
                if np.count_nonzero(known[own_grams[first : max(first, last - GRAM + 1)]]) < least:
                    continue
                distance, end = best_match(item, plain[i][first:last].decode("latin-1"))
                if distance <= allowed and (best is None or (distance, first + end) < best):
                    best = (distance, first + end)
            if best:
                out += [(i, own, best[0], len(item), best[1]) for own in ids]
        return out


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[list[int | None], str]]]:
    """Distinct normalised items with all their ids, in blocks of bounded size; a distinct row is in one block."""
    rows = benchmark.where("text is not null").select("text", F.col("item_id").cast("long").alias("item_id")).distinct().orderBy(F.asc_nulls_last("item_id"), "text")
    block: dict[str, list[int | None]] = {}
    held = 0
    for r in rows.toLocalIterator():
        text = normalise(r["text"])
        if text:
            if text not in block:
                held += len(text)
            block.setdefault(text, []).append(r["item_id"])
            held += 8
            if held >= block_bytes:
                yield [(i, t) for t, i in block.items()]
                block, held = {}, 0
    if block:
        yield [(i, t) for t, i in block.items()]


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_bytes: int = 4 << 20) -> DataFrame:
    """One row for every (document row, item) where the document contains the item."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in item_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast((block, rate))  # at most block_bytes of item texts and one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = worker_slot(("items", key), lambda: ItemIndex(*shared.value))
            for batch in text_slices(batches, "text", SLICE):
                ids = batch.column("doc_id").to_pylist()
                rows = index.search(strings(batch.column("text")))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64())], names=["doc_id", "item_id", "distance", "item_bytes", "at"])

        found = source.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    out = docs
    for block in item_blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((block, rate))

        def judge(shared=shared, key=uuid.uuid4().hex):
            index = worker_slot(("items", key), lambda: ItemIndex(*shared.value))

            def passes(texts: list[str]) -> list[bool]:
                bad = {r[0] for r in index.search(texts)}
                return [i not in bad for i in range(len(texts))]

            return passes

        out = filter_texts(out, judge, SLICE)
    return out


def edited(text: str, edits: int, r: random.Random) -> str:
    """``text`` with random insertions, deletions and changes; for measuring recall."""
    chars = list(text)
    for _ in range(edits):
        at, kind = r.randrange(len(chars) + 1), r.randrange(3)
        if kind == 0:
            chars.insert(at, r.choice("etaoin"))
        elif at < len(chars):
            if kind == 1:
                del chars[at]
            else:
                chars[at] = r.choice("etaoin")
    return "".join(chars)
