"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over labelled text. A text is
parsed against each automaton into phrases, each the longest match from where
the last one ended, across words. With ``c`` phrases over ``n`` letters and a
training text of ``N`` letters, ``c * log2(N) / n`` estimates the cross entropy
in bits a letter; the language with the fewest (so normalised) phrases wins.

Texts are parsed whole, in lower case, with what stands between letters (Unicode
category L) as one space. All texts of a batch and all languages advance together
in numpy; for that a text is cut into stretches of 1,024 letters, where a phrase
ends too, which adds at most one phrase a stretch in every language alike.
Automata are sparse: their moves lie in one table by displaced rows.

Defined results: null texts and texts without a letter give ``und`` and score
0; equal entropies go to the alphabetically first language; letters that no
language has are phrases of their own; an empty table gives an empty result;
without any labelled text every result is ``und``. Repeated rows are scored one
by one, columns other than id and text are not read, so names cannot clash. Very
long texts are read whole; a slice holds at least one of them.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, filter_texts, strings, text_slices, worker_slot

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_letter double, phrases_per_letter double"
STRETCH = 1_024  # letters parsed in one go
SLICE = 4 << 20  # bytes of text at a time
LANGUAGES = 1_000  # most languages that are learned, the most frequent ones


def plain(text: str) -> str:
    """Letters in lower case, each run of other characters between them as one space."""
    return " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split())


class SuffixAutomaton:
    """All substrings of a text; state 0 is the empty string."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][ch]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new

    def phrases(self, text: str) -> int:
        """The number of phrases of a plain greedy cross-parse."""
        state = count = 0
        for ch in text:
            state_next = self.next[state].get(ch)
            if state_next is None:
                count += state > 0
                state_next = self.next[0].get(ch)
                if state_next is None:
                    count, state_next = count + 1, 0
            state = state_next
        return count + (state > 0)


@dataclass
class LanguageModel:
    """Automata of all languages, one after another.

    The move of state s by character c lies in slot ``base[s] + c`` if ``owner`` of that
    slot is s. Roots own no slot; their moves are ``first``, by language and character.
    """

    languages: list[str]
    alphabet: dict[str, int]  # from 1; 0 is the space, the last number any other letter
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    roots: np.ndarray
    first: np.ndarray
    log_size: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def code_table(self) -> np.ndarray:
        """The number of every code point: 0 for what is no letter."""
        other = len(self.alphabet) + 1
        get = self.alphabet.get
        return np.fromiter((get(c.lower()[0], other) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)), np.uint16, 0x110000)

    def worker_table(self) -> np.ndarray:
        return worker_slot(("language", self.key), self.code_table)

    def parse(self, codes: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and its phrases in each language (texts x languages)."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        number = codes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        owner = np.repeat(np.arange(len(texts)), size)
        letter = number > 0
        letters = np.bincount(owner[letter], minlength=len(texts))
        # a space stays where a letter of the same text stands right before it
        keep = letter.copy()
        keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
        flat, owner = number[keep], owner[keep]
        count = np.bincount(owner, minlength=len(texts))
        stretches = -(-count // STRETCH)
        of = np.repeat(np.arange(len(texts)), stretches)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        start = (np.cumsum(count) - count)[of] + nth * STRETCH
        length = np.minimum(count[of] - nth * STRETCH, STRETCH)
        order = np.argsort(-length, kind="stable")
        of, start, length = of[order], start[order], length[order]
        state = np.repeat(self.roots[:, None], len(of), 1)
        phrases = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
        for j, n in enumerate(live.tolist()):  # stretches longer than j come first
            c = flat[start[:n] + j]
            now = state[:, :n]
            slot = self.base[now] + c
            stays = self.owner[slot] == now
            phrases[:, :n] += ~stays
            state[:, :n] = np.where(stays, self.target[slot], self.first[:, c])
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        for k, row in enumerate(phrases):
            total[k] = np.bincount(of, row, len(texts))
        return letters, total.T


def displaced(moves: list[dict[int, int]], roots: set[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All moves in one table of slots: a state's moves start at its base, rows of several moves where they fit."""
    edges = sum(len(m) for s, m in enumerate(moves) if s not in roots)
    size = 2 * edges + 4 * width + 64
    owner, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    base = np.zeros(len(moves), np.int32)
    used = bytearray(size)
    r = random.Random(5)
    single = []
    for s in sorted((s for s in range(len(moves)) if s not in roots), key=lambda s: -len(moves[s])):
        if len(moves[s]) < 2:
            single.append(s)
            continue
        at = r.randrange(size - width)
        while any(used[at + c] for c in moves[s]):
            at = r.randrange(size - width)
        base[s] = at
        for c, to in moves[s].items():
            used[at + c], owner[at + c], target[at + c] = 1, s, to
    free = width
    for s in single:
        for c, to in moves[s].items():
            while used[free]:
                free += 1
            base[s] = free - c
            used[free], owner[free], target[free] = 1, s, to
    return base, owner, target


def train(samples: dict[str, list[str]], letters: int = 30_000) -> LanguageModel:
    """Automata over the first ``letters`` letters (with spaces) of each language's sample texts."""
    languages = sorted(samples)
    texts = []
    for lang in languages:
        parts, left = [], letters
        for text in samples[lang]:
            parts.append(plain(text)[:left])
            left -= len(parts[-1])
            if left <= 0:
                break
        texts.append(" ".join(filter(None, parts)))
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(texts)) - {" "}))}
    width = len(alphabet) + 2
    number = alphabet | {" ": 0}
    moves: list[dict[int, int]] = []
    roots, first = [], np.zeros((len(languages), width), np.int32)
    for k, text in enumerate(texts):
        at = len(moves)
        roots.append(at)
        moves += [{number[c]: to + at for c, to in m.items()} for m in SuffixAutomaton(text).next]
        first[k] = at  # a character that the language doesn't have leads back to its root
        for c, to in moves[at].items():
            first[k, c] = to
    base, owner, target = displaced(moves, set(roots), width)
    return LanguageModel(languages, alphabet, base, owner, target, np.array(roots, np.int32), first, np.log2([len(t) + 1 for t in texts]))


def learn(docs: DataFrame, learn_where: Column, docs_each: int = 60, letters: int = 30_000, languages: int = LANGUAGES) -> LanguageModel:
    """Train on at most ``docs_each`` documents and ``letters`` letters of each of the ``languages`` most frequent languages.

    Of a document's text, ``4 * letters`` characters come to the driver, which looks for its letters there.
    """
    texts = docs.where(learn_where).where("text is not null").select("doc_id", "lang", F.substring("text", 1, 4 * letters).alias("text"))
    rows = bounded_sample(texts, "lang", "doc_id", docs_each, most_strata=languages)
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r["lang"], []).append(r["text"])
    return train({k: v for k, v in samples.items() if any(map(plain, v))}, letters)


def score_texts(model: LanguageModel, codes: np.ndarray, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, bits and phrases a letter of each text; the last two are NaN without a letter."""
    letters, phrases = model.parse(codes, texts)
    has = letters > 0
    best = np.zeros(len(texts), np.int64)
    score, low, rate = np.zeros(len(texts)), np.full(len(texts), np.nan), np.full(len(texts), np.nan)
    if not model.languages or not has.any():
        return ["und"] * len(texts), score, low, rate
    bits = phrases[has] * model.log_size / letters[has, None]
    top = bits.argmin(1)
    rows = np.arange(len(bits))
    best[has], low[has], rate[has] = top, bits[rows, top], phrases[has, top] / letters[has]
    if len(model.languages) == 1:
        score[has] = 1.0
    else:
        bits[rows, top] = np.inf
        second = bits.min(1)
        score[has] = np.clip(1 - low[has] / np.maximum(second, 1e-12), 0, 1)
    return [model.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], score, low, rate


def identify(docs: DataFrame, model: LanguageModel, held_out: Column) -> DataFrame:
    """One row a document; a map over the scan without any shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB at most for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        codes = m.worker_table()
        for batch in text_slices(batches, "text", SLICE):
            lang, score, bits, rate = score_texts(m, codes, strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(bits, from_pandas=True), pa.array(rate, from_pandas=True)], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_letter", "phrases_per_letter"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame, model: LanguageModel, most_phrases: float = 0.75) -> DataFrame:
    """The rows in a language that was learned, with all their columns.

    Texts without a letter go, and texts with more than ``most_phrases`` phrases a
    letter even in their best language: three of four letters then start a phrase, as
    in scripts and languages that no training text had. Running text of a learned
    language stays far below (about 0.3).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        m = shared.value
        codes = m.worker_table()
        return lambda texts: (score_texts(m, codes, texts)[3] <= most_phrases).tolist()

    return filter_texts(docs, judge, SLICE)
