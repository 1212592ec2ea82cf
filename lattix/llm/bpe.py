"""Byte-level BPE by a dynamic program over prefixes, with exact appends and edits.

A sequence of tokens is the BPE encoding of its bytes exactly if every two
neighbours are the encoding of their joined bytes. Hence each prefix of a piece
has one valid last token: the one that ends there and goes with the last token of
the shorter prefix before it. Storing it for every prefix encodes a piece in time
linear in its length, makes appending continue where the table ends, and lets an
edit stop as soon as the table agrees with the old one again.

A text is split by the pattern first and every match is encoded by itself; a
match that is a token as a whole is that token, as in the tiktoken library.
Encodings of distinct matches are kept in each worker, up to a bounded number.

Defined results: null and empty texts have no token, an empty id list and no
bytes; every other text round-trips; very long matches cost linear time; an empty
table gives an empty result; repeated rows repeat; only id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, text_slices, worker_slot

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """Ranks with the test whether two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], most_pairs: int = 400_000):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.most_pairs = most_pairs

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: merge the neighbours of lowest rank, leftmost first. Only used on a token or two."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left, right`` is the encoding of its bytes; left is -1 at the start of a piece."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            if left < 0:
                known = self.merge(self.bytes_of[right]) == [right]
            else:
                known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.pairs[left, right] = known
        return known


class PrefixTable:
    """The last token, and where it starts, of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last = [-1]
        self.start = [0]
        self.steps = 0
        self.append(data)

    def _place(self, data: bytes, end: int) -> tuple[int, int]:
        self.steps += 1
        ranks, fits, last = self.vocabulary.ranks, self.vocabulary.fits, self.last
        for begin in range(max(0, end - self.vocabulary.longest), end):
            token = ranks.get(data[begin:end])
            if token is not None and fits(last[begin], token):
                return token, begin
        raise ValueError("the ranks do not have every byte")

    def append(self, more: bytes) -> None:
        self.data = data = self.data + more
        for end in range(len(self.last), len(data) + 1):
            token, begin = self._place(data, end)
            self.last.append(token)
            self.start.append(begin)

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Put ``new`` in the place of bytes ``begin`` to ``end``; work stops where old and new agree."""
        old_last, old_start, shift = self.last, self.start, len(new) - (end - begin)
        self.data = data = self.data[:begin] + new + self.data[end:]
        self.last, self.start = old_last[: begin + 1], old_start[: begin + 1]
        agree = 0
        for at in range(begin + 1, len(data) + 1):
            token, start = self._place(data, at)
            self.last.append(token)
            self.start.append(start)
            old = at - shift
            same = old > end and old_last[old] == token
            agree = agree + 1 if same else 0
            # the next entries look back over `longest` bytes that all lie behind the edit and agree
            if agree >= self.vocabulary.longest and start - shift >= end:
                self.last += old_last[old + 1 :]
                self.start += [s + shift for s in old_start[old + 1 :]]
                return

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end = self.start[end]
        return out[::-1]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 600_000):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, str] = _Kept(self, most)
        self.bytes_of_decimal = {str(i): b for b, i in ranks.items()}

    def piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        return [whole] if whole is not None else PrefixTable(self.vocabulary, data).tokens()

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in d.split(",")] if (d := self.decimal(text)) else []

    def decimal(self, text: str) -> str:
        """The ids of a text in decimal, joined by commas."""
        return ",".join(map(self.kept.__getitem__, self.pattern.findall(text)))

    def decode_decimal(self, decimal: str) -> bytes:
        return b"".join(map(self.bytes_of_decimal.__getitem__, decimal.split(","))) if decimal else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class _Kept(dict):
    """Encodings of pieces; emptied when it holds ``most``."""

    def __init__(self, encoder: Encoder, most: int):
        super().__init__()
        self.encoder, self.most = encoder, most

    def __missing__(self, piece: str) -> str:
        if len(self) >= self.most:
            self.clear()
        self[piece] = ids = ",".join(map(str, self.encoder.piece(piece)))
        return ids


class TextEncoding:
    """The encoding of a text that can be appended to and edited.

    The pattern looks ahead one character and never back, so a match that ends
    some matches before a change stays, and once a new match starts where an old
    one did behind the change, all later ones are the old ones.
    """

    BACK = 3  # a contraction of an apostrophe and two letters may join three old matches

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.ends: list[int] = []
        self.ids: list[list[int]] = []
        self._match(0, None)

    def _match(self, at: int, stop: dict[int, int] | None) -> int | None:
        for m in self.encoder.pattern.finditer(self.text, at):
            if stop is not None and m.start() in stop:
                return stop[m.start()]
            self.ends.append(m.end())
            self.ids.append([int(x) for x in self.encoder.kept[m[0]].split(",")])
        return None

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> None:
        old_ends, old_ids, shift = self.ends, self.ids, len(new) - (end - begin)
        keep = 0
        while keep < len(old_ends) and old_ends[keep] <= begin:
            keep += 1
        keep = max(0, keep - self.BACK)
        self.text = self.text[:begin] + new + self.text[end:]
        self.ends, self.ids = old_ends[:keep], old_ids[:keep]
        # old matches that start behind the edit, by their new start
        stop = {e + shift: i + 1 for i, e in enumerate(old_ends[:-1]) if i >= keep and e >= end and e + shift > begin + len(new)}
        joined = self._match(self.ends[-1] if self.ends else 0, stop)
        if joined is not None:
            self.ends += [e + shift for e in old_ends[joined:]]
            self.ids += old_ids[joined:]

    def tokens(self) -> list[int]:
        return [i for ids in self.ids for i in ids]


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Encode, decode and digest every text; a map over the scan without any shuffle.

    ``rank_path`` is read on each executor, where the vocabulary is installed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_slot(("bpe", rank_path, pattern), lambda: Encoder(read_ranks(rank_path), pattern))
        for batch in text_slices(batches, "text", 4 << 20):
            counts, ids, decoded = [], [], []
            for text in strings(batch.column("text")):
                decimal = encoder.decimal(text)
                counts.append(decimal.count(",") + 1 if decimal else 0)
                ids.append(hashlib.sha256(decimal.encode()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode_decimal(decimal)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
