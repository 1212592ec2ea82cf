"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel compares two strings by their common subsequences of four characters
within seven places, contiguous or not; every place skipped costs a factor, so
gapped spellings and inserted characters lower the similarity only a little.
Nyström landmarks (a bounded set of training strings) turn the kernel into a
feature vector ``K_mm^(-1/2) k(x, landmarks)``, and a linear machine is trained on
it with the hinge loss.

A sentence is toxic as far as its most toxic span is: the machine is trained on
sentences as bags of spans (words with anchors at both ends, and runs of
one-letter pieces as in "b a d" joined), taking the highest span of each toxic
sentence as its example, and all spans of sentences of clean documents as
counter-examples. The score of a document is that of its highest span, through a
logistic curve fitted on training documents. Common digit and sign substitutions
are undone first. Long spans are scored in overlapping windows, so whole texts
count. Span scores are kept by span in each worker.

Defined results: null and empty texts, and texts without a letter, score that of
no evidence (0); without training rows of both classes every score is 0; an empty
table gives an empty result; repeated rows repeat; very long texts are read whole, a
slice holds at least one of them; only id and text are read, so names cannot clash.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TokenTable, filter_texts, strings, text_slices, tidy, worker_slot

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, span string"
THRESHOLD = 0.7
ORDER, SPAN, DECAY, WINDOW, STRIDE = 4, 7, 0.6, 24, 12
STEMS = range(5, 10)  # lengths of stems, with the anchor
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
NO_LETTER = re.compile(r"[\W\d_]+")
PIECES = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][\W\d_]{1,3}){3,}[^\W\d_](?![^\W\d_])")
#: Signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
INNER = re.compile(r"(?<=[^\W\d_])[0134579@$!]+(?=[^\W\d_])")


@lru_cache(maxsize=200_000)
def clean(span: str) -> str:
    """Lower case, inner signs as the letters they stand for, letters only."""
    return NO_LETTER.sub("", INNER.sub(lambda m: m[0].translate(SIGNS), span.lower()))


def spans(text: str) -> list[str]:
    """White-space words, and runs of single letters as one span each."""
    out = text.split()
    out.extend(m[0] for m in PIECES.finditer(text))
    return out


def windows(word: str) -> list[str]:
    """``^word$``, or overlapping windows of it where it is long."""
    whole = f"^{word}$"
    if len(whole) <= WINDOW:
        return [whole]
    return [whole[i : i + WINDOW] for i in range(0, len(whole) - WINDOW + STRIDE, STRIDE)]


ALPHABET = 4_096  # codes of characters: 0 is padding and what training didn't have
SLICE = 2 << 20  # bytes of text at a time
MOST_CHARS = 5_000_000  # of either class to train on; training takes some 30 MB of memory a million
SPREAD = 0x9E3779B97F4A7C15
PATTERNS = [(0, *mid) for mid in combinations(range(1, SPAN), ORDER - 1)]


class Strings:
    """The explicit feature map of the kernel over the characters of training strings.

    A feature is a subsequence of ``ORDER`` characters that spans at most ``SPAN``
    places; each occurrence adds ``DECAY ** (places spanned - ORDER)``. Features are
    numbered by their characters, so the map has ``ALPHABET ** ORDER`` dimensions of
    which a string uses a few hundred at most. Characters past the ``ALPHABET - 1`` most
    frequent ones share codes with others.
    """

    def __init__(self, words: list[str]):
        common = [c for c, _ in sorted(Counter("".join(words)).items(), key=lambda x: (-x[1], x[0]))]
        self.code = {c: i % (ALPHABET - 1) + 1 for i, c in enumerate(common)}

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature number and weight of every occurrence in every string."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        get = self.code.get
        flat = np.fromiter((get(c, 0) for w in words for c in w), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        ends = np.repeat(np.cumsum(lengths), lengths)
        place = np.arange(len(flat))
        rows, numbers, weights = [], [], []
        for pattern in PATTERNS:
            at = place[place + pattern[-1] < ends]
            number, known = np.zeros(len(at), np.int64), np.ones(len(at), bool)
            for step in pattern:
                c = flat[at + step]
                known &= c > 0
                number = number * ALPHABET + c
            rows.append(owner[at[known]])
            numbers.append(number[known])
            weights.append(np.full(int(known.sum()), DECAY ** (pattern[-1] + 1 - ORDER), np.float32))
        return np.concatenate(rows), np.concatenate(numbers), np.concatenate(weights)


def vectors(strings: Strings, words: list[str]) -> list[dict[int, float]]:
    out: list[dict[int, float]] = [{} for _ in words]
    for r, n, w in zip(*(x.tolist() for x in strings.features(words)), strict=True):
        out[r][n] = out[r].get(n, 0.0) + w
    return out


def norms(strings: Strings, words: list[str]) -> np.ndarray:
    return np.sqrt([max(1e-12, sum(v * v for v in x.values())) for x in vectors(strings, words)])


def kernel(strings: Strings, words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of every string with every landmark, landmarks scaled to length 1."""
    of = vectors(strings, landmarks)
    length = norms(strings, landmarks)
    used = np.array(sorted({n for x in of for n in x}), np.int64)
    table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for m, x in enumerate(of):
        table[np.searchsorted(used, list(x)), m] = np.array(list(x.values())) / length[m]
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for start in range(0, len(words), 2_000):
        rows, numbers, weights = strings.features(words[start : start + 2_000])
        at = np.minimum(np.searchsorted(used, numbers), len(used) - 1)
        hit = used[at] == numbers
        rows, at, weights = rows[hit], at[hit], weights[hit]
        order = np.argsort(rows, kind="stable")
        rows, at, weights = rows[order], at[order], weights[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
        for k in range(0, len(first), 200):
            lo, hi = first[k], first[k + 200] if k + 200 < len(first) else len(rows)
            got = np.add.reduceat(table[at[lo:hi]] * weights[lo:hi, None], first[k : k + 200] - lo, axis=0)
            out[start + rows[first[k : k + 200]]] = got
    return out


@dataclass
class ToxicityModel:
    """The machine with its kernel expansion summed up: one weight for each feature that a landmark has.

    ``sum_m alpha_m k(x, landmark_m)`` equals the sum of ``weights`` over the features
    of x, which costs the same for any number of landmarks.
    """

    strings: Strings
    landmarks: list[str]
    alpha: np.ndarray  # weights on kernels with the landmarks: w K_mm^(-1/2)
    bias: float
    curve: tuple[float, float] = (0.0, 0.0)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        length = norms(self.strings, self.landmarks)
        total: dict[int, float] = {}
        for m, x in enumerate(vectors(self.strings, self.landmarks)):
            for n, v in x.items():
                total[n] = total.get(n, 0.0) + v / length[m] * float(self.alpha[m])
        self.bits = 1
        while (1 << self.bits) < 8 * len(total):
            self.bits += 1
        # an open table over the feature numbers: slot by number modulo its size, probed onwards
        self.size = 1 << self.bits
        self.slot_number = np.full(self.size, -1, np.int64)
        self.slot_weight = np.zeros(self.size, np.float32)
        self.probes = 1
        for n in sorted(total):
            k, tries = ((n * SPREAD & 0xFFFFFFFFFFFFFFFF) >> 32) & (self.size - 1), 1
            while self.slot_number[k] >= 0:
                k, tries = (k + 1) & (self.size - 1), tries + 1
            self.slot_number[k], self.slot_weight[k] = n, total[n]
            self.probes = max(self.probes, tries)

    def worker_table(self) -> TokenTable:
        return worker_slot(("toxicity", self.key), lambda: TokenTable(self.span_scores, 1))

    def margins(self, words: list[str], step: int = 4_000) -> np.ndarray:
        """The machine's value of every string; ``step`` strings have their features in memory at a time."""
        parts = [self._margins(words[k : k + step]) for k in range(0, len(words), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _margins(self, words: list[str]) -> np.ndarray:
        rows, numbers, weights = self.strings.features(words)
        k = ((numbers.astype(np.uint64) * np.uint64(SPREAD) >> np.uint64(32)) & np.uint64(self.size - 1)).astype(np.int64)
        value = np.where(self.slot_number[k] == numbers, self.slot_weight[k], np.float32(0))
        rest = np.flatnonzero((self.slot_number[k] != numbers) & (self.slot_number[k] >= 0))
        for _ in range(1, self.probes):
            if not len(rest):
                break
            k[rest] = (k[rest] + 1) & (self.size - 1)
            got = self.slot_number[k[rest]]
            hit = got == numbers[rest]
            value[rest[hit]] = self.slot_weight[k[rest[hit]]]
            rest = rest[(~hit) & (got >= 0)]
        return np.bincount(rows, value * weights, len(words)) + self.bias

    def span_scores(self, raw: list[str]) -> np.ndarray:
        """The margin of every span, its highest window's."""
        pieces, owner = [], []
        for i, s in enumerate(raw):
            word = clean.__wrapped__(s)
            if len(word) > 1:
                got = windows(word)
                pieces.extend(got)
                owner.extend([i] * len(got))
        out = np.full((len(raw), 1), -np.inf, np.float32)
        if pieces:
            np.maximum.at(out[:, 0], owner, self.margins(pieces))
        return out


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600, ridge: float = 2e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by accelerated descent."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    v = w.copy()
    rate = 0.5 / (np.linalg.eigvalsh((x * weight[:, None]).T @ x / weight.sum())[-1] + ridge)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * x.T @ (weight * y * slack) / weight.sum() + 2 * ridge * np.r_[v[:-1], 0]
        nxt = v - rate * grad
        v = nxt + k / (k + 3) * (nxt - w)
        w = nxt
    return w


def witnesses(sample: list[tuple[str, int]], least: float) -> tuple[list[tuple[str, set[str]]], Counter]:
    """Labelled sentences: those of toxic documents with a marked string, with that string; and the strings of clean documents.

    A string is marked by the log odds of its document counts, or those of one of its
    stems, so that inflected forms of a stem find each other.
    """
    labels = [y for _, y in sample]
    bags: list[set[str]] = []
    counts = (Counter(), Counter())
    plain: Counter = Counter()
    seen: set[int] = set()  # 64-bit hashes of (label, string, the word before)
    cut: dict[str, list[str]] = {}  # each word's windows, so that equal strings are one object
    for text, label in sample:
        own: set[str] = set()
        for sentence in SENTENCE.split(text):
            found = []
            before = ""
            for s in spans(sentence):
                word = clean(s)
                if len(word) > 1:
                    if word not in cut:
                        cut[word] = windows(word)
                    for w in cut[word]:
                        found.append(w)
                        # a string after the same word counts once, so copies of a document don't add up
                        if (key := hash((label, w, before))) not in seen:
                            seen.add(key)
                            counts[label].update({w, *(w[:k] for k in STEMS if k < len(w))})
                before = word
            if found:
                if label:
                    bags.append(set(found))
                own.update(found)
        if not label:
            plain.update(own)
    n1, n0 = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    known: dict[str, float] = {}

    def odds(s: str) -> float:
        if s not in known:
            known[s] = float(np.log((counts[1][s] + 0.1) / n1) - np.log((counts[0][s] + 0.5) / n0))
        return known[s]

    out = []
    for found in bags:
        top = max((max(odds(s) for s in (w, *(w[:k] for k in STEMS if k < len(w)))), w) for w in found)
        if top[0] > least:
            out.append((top[1], found))
    return out, plain


def train(sample: list[tuple[str, int]], landmarks: int = 240, counter: int = 4_000) -> ToxicityModel | None:
    """``landmarks`` bounds the landmark set, ``counter`` the strings of clean sentences that join the counter-examples in a turn."""
    labels = [y for _, y in sample]
    if len(set(labels)) < 2:
        return None
    labelled, plain = witnesses(sample, 3.6)
    labelled = labelled or witnesses(sample, 1.0)[0]
    if not labelled:
        return None
    chosen = Counter(t for t, _ in labelled)
    clean_words = [w for w, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0]))]
    strings = Strings(clean_words + list(chosen) * 5)
    marks = [w for w, _ in sorted(chosen.items(), key=lambda x: (-x[1], x[0]))][: landmarks * 2 // 3]
    # the other landmarks are the clean strings that come closest to the toxic ones
    pool = clean_words[: 3 * counter]
    near = kernel(strings, pool, marks).max(1) if pool else np.zeros(0)
    close = [pool[i] for i in np.argsort(-near, kind="stable") if pool[i] not in chosen]
    marks += close[: landmarks - len(marks)]
    kmm = kernel(strings, marks, marks).astype(np.float64) / norms(strings, marks)[:, None]
    values, axes = np.linalg.eigh((kmm + kmm.T) / 2)
    root = axes @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ axes.T  # Nyström: K_mm^(-1/2)
    negative = sorted(set(close[:counter]) | set(clean_words[:1_000]) - set(chosen))
    xn = kernel(strings, negative, marks) @ root
    positive = [t for t, _ in labelled]
    model = None
    for turn in range(3):
        many = Counter(positive)
        for word in sorted(many):  # each also with a character put in, at two places
            for k in (1 + len(word) // 3, 1 + len(word) // 2):
                if len(word) > 6:
                    many[word[:k] + "xzkw"[(k + len(word)) % 4] + word[k:]] += 1
        distinct = sorted(many)
        x = np.concatenate([kernel(strings, distinct, marks) @ root, xn])
        wp = np.sqrt([many[w] for w in distinct])
        wn = np.full(len(negative), 2 * wp.sum() / max(1, len(negative)))
        fit = hinge(x, np.r_[np.ones(len(wp)), -np.ones(len(wn))], np.r_[wp, wn])
        model = ToxicityModel(strings, marks, root @ fit[:-1], float(fit[-1]))
        if turn == 2:
            break
        # the highest string of each toxic sentence anew; clean strings that score high join the counter-examples
        every = sorted({w for _, found in labelled for w in found})
        margin = dict(zip(every, model.margins(every), strict=True))
        positive = [max(((margin[w] + (w == t), w) for w in found))[1] for t, found in labelled]
        got = model.margins(clean_words) if clean_words else np.zeros(0)
        ahead = [clean_words[i] for i in np.argsort(-got, kind="stable")[:counter] if got[i] > -1]
        if fresh := sorted(set(ahead) - set(negative) - set(positive)):
            negative += fresh
            xn = np.concatenate([xn, kernel(strings, fresh, marks) @ root])
    table = TokenTable(model.span_scores, 1, 100_000)
    best = np.concatenate([document_margins(table, [t for t, _ in sample[k : k + 100]])[0] for k in range(0, len(sample), 100)])
    known = np.isfinite(best)
    model.curve = fit_curve(best[known], np.array(labels)[known])
    clean.cache_clear()
    del table, labelled, plain, clean_words, strings, xn
    tidy()
    return model


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve with both classes weighted alike."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    z = np.stack([np.clip(x, -4, 4), np.ones(len(x))], 1)
    c = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        g = z.T @ (w * (y - p)) - np.array([1e-4, 0]) * c
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        d = np.linalg.solve(h, g)
        c = c + d
        if np.abs(d).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def document_margins(table: TokenTable, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
    """The highest margin of each text and the span that has it; minus infinity without a span."""
    lists = [list(dict.fromkeys(spans(t))) for t in texts]
    rows, counts = table.lookup(lists)
    best = np.full(len(texts), -np.inf)
    words: list[str | None] = [None] * len(texts)
    at = 0
    for i, n in enumerate(counts.tolist()):
        if n:
            k = int(np.argmax(rows[at : at + n, 0]))
            if np.isfinite(rows[at + k, 0]):
                best[i], words[i] = rows[at + k, 0], lists[i][k]
        at += n
    return best, words


def score_texts(model: ToxicityModel | None, table: TokenTable | None, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
    if model is None:
        return np.zeros(len(texts)), [None] * len(texts)
    best, words = document_margins(table, texts)
    a, b = model.curve
    score = np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(a * np.clip(np.where(np.isfinite(best), best, 0), -4, 4) + b, -30, 30))), 0.0)
    return score, words


def score(docs: DataFrame, model: ToxicityModel | None, held_out: Column) -> DataFrame:
    """One row a document, with its most toxic span; a map over the scan without any shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some dozens of strings and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m and m.worker_table()
        for batch in text_slices(batches, "text", SLICE):
            got, words = score_texts(m, table, strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32)), pa.array(words, pa.string())], names=["doc_id", "held_out", "score", "predicted", "span"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        m = shared.value
        table = m and m.worker_table()
        return lambda texts: (score_texts(m, table, texts)[0] < THRESHOLD).tolist()

    return filter_texts(docs, judge, SLICE)
