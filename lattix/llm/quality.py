"""Document quality from a linear-chain conditional random field over lines.

Every line is ``bad`` (0) or ``good`` (1). The potentials of a line come from
its own features and those of the lines before and after it, and neighbouring
labels have transition weights. Forward and backward passes give each line's
marginal; their mean weighted by line length, put through a logistic curve
fitted on the training documents, is the score of the document.

Labels exist for documents only. Lines start with the label of their document;
lines of bad documents that look good to the model then change sides, and the
field is fitted again. Line features are computed in numpy over the bytes of a
batch; whole texts are read.

Defined results: null and empty texts, and texts of white space only, score the
share of good training documents; without training rows every score is 0.5.
Ties cannot arise (a row's score doesn't depend on others), repeated rows repeat, an
empty table gives an empty result, and only id and text are read, so other columns'
names cannot clash. Very long texts are read whole; a slice holds at least one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_slot, text_bytes, text_slices

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, good_share double"
THRESHOLD = 0.3

_byte = np.arange(256)
_is_upper = (_byte >= 65) & (_byte <= 90)
_is_lower = (_byte >= 97) & (_byte <= 122)
_is_digit = (_byte >= 48) & (_byte <= 57)
_is_high = _byte >= 128
_is_space = np.isin(_byte, [9, 10, 11, 12, 13, 32])
_is_stop = np.isin(_byte, list(b".,;:?"))
_is_mark = ~(_is_upper | _is_lower | _is_digit | _is_high | _is_space | _is_stop) & (_byte >= 33)
#: Class of every byte: 0 other, 1 upper, 2 lower, 3 digit, 4 part of a longer character, 5 space, 6 stop, 7 mark.
CLASS = (_is_upper + 2 * _is_lower + 3 * _is_digit + 4 * _is_high + 5 * _is_space + 6 * _is_stop + 7 * _is_mark).astype(np.uint8)
OWN = 10  # features of a line by itself
LINE_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (own, before, after, constant), byte length and document of every line that isn't blank."""
    docs = len(bounds) - 1
    width = 3 * OWN + 1
    if not len(raw):
        return np.zeros((0, width), np.float32), np.zeros(0), np.zeros(0, np.int64)
    kind = CLASS[raw]
    cut = np.union1d(np.flatnonzero(raw == 10) + 1, bounds)
    cut = cut[cut <= len(raw)]
    start, end = cut[:-1], cut[1:]
    doc = np.searchsorted(bounds, start, "right") - 1

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, start, dtype=np.int32).astype(np.float32)

    space = kind == 5
    size = total(~space)
    word_start = ~space
    word_start[1:] &= space[:-1]
    word_start[bounds[:-1][bounds[:-1] < len(raw)]] = ~space[bounds[:-1][bounds[:-1] < len(raw)]]
    at = np.flatnonzero(word_start)
    words = total(word_start)
    # hash each word by the bytes from its start to the next word's start, spaces counting 0
    weight = np.where(space, 0, raw.astype(np.uint64) + np.uint64(1))
    position = np.arange(len(raw), dtype=np.uint64)
    if len(at):
        ordinal = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(raw)))) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.repeat(np.arange(len(at)), np.diff(np.append(at, len(raw))))])
        inside = position - at[ordinal].astype(np.uint64) + np.uint64(1)
        mixed = weight * inside * LINE_MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= weight
        hashed = np.add.reduceat(mixed, at)
        same = np.zeros(len(at), bool)
        of = np.searchsorted(bounds, at, "right")
        same[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
        repeat = np.zeros(len(raw), np.uint8)
        repeat[at[same]] = 1
        repeats = total(repeat)
    else:
        repeats = np.zeros(len(start), np.float32)
    keep = size > 0
    doc, size, words = doc[keep], size[keep], np.maximum(words[keep], 1)
    letters = np.maximum(total((kind == 1) | (kind == 2) | (kind == 4))[keep], 1)
    own = np.stack(
        [
            total(kind == 1)[keep] / letters,
            total(kind == 2)[keep] / size,
            total(kind == 3)[keep] / size,
            total(kind == 6)[keep] / words,
            np.minimum(total(kind == 7)[keep] / words, 4),
            np.minimum(total(raw == 33)[keep] / words, 3),
            np.minimum(total(raw == 124)[keep] / words, 3),
            repeats[keep] / words,
            np.log1p(words) / 5,
            np.minimum(letters / words, 30) / 10,
        ],
        1,
    ).astype(np.float32)
    before = np.zeros_like(own)
    after = np.zeros_like(own)
    linked = np.flatnonzero(doc[1:] == doc[:-1])
    before[linked + 1] = own[linked]
    after[linked] = own[linked + 1]
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], 1), size.astype(np.float64), doc


@dataclass
class QualityModel:
    weights: np.ndarray  # a line's feature weights for good against bad
    transitions: np.ndarray  # 2 x 2 log weights
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float]
    prior: float

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights


def marginals(emission: np.ndarray, doc: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, the expected transitions (2 x 2), and each document's log partition.

    All chains advance together, longest first, so the loop is as long as the longest one.
    """
    n = len(emission)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if n else np.zeros(0, np.int64)
    length = np.diff(np.r_[first, n])
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    trans = np.exp(transitions)
    psi = np.stack([np.exp(np.minimum(0, -emission)), np.exp(np.minimum(0, emission))], 1)
    alpha = np.zeros((n, 2))
    norm = np.ones(n)
    live_at = np.searchsorted(-length, -np.arange(int(length.max()) if n else 0), "left")
    for j, live in enumerate(live_at):
        at = first[:live] + j
        a = psi[at] if j == 0 else (alpha[at - 1] @ trans) * psi[at]
        norm[at] = a.sum(1)
        alpha[at] = a / norm[at][:, None]
    beta = np.ones((n, 2))
    expected = np.zeros((2, 2))
    for j in range(len(live_at) - 2, -1, -1):
        live = live_at[j + 1]
        at = first[:live] + j
        push = psi[at + 1] * beta[at + 1] / norm[at + 1][:, None]
        expected += trans * (alpha[at].T @ push)
        beta[at] = push @ trans.T
    good = alpha * beta
    good = good[:, 1] / np.maximum(good.sum(1), 1e-300)
    return good, expected, norm


def fit_chain(x: np.ndarray, y: np.ndarray, doc: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of labelled chains by Adam."""
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    linked = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[linked], y[linked + 1]), 1)
    for step in range(1, steps + 1):
        good, expected, _ = marginals(x @ w, doc, t)
        grads = [x.T @ (y - good) / len(x) - ridge * w, (seen - expected) / len(x) - ridge * t]
        for k, (p, g) in enumerate(zip((w, t), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += 0.15 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return w, t


def fit_curve(share: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """A logistic curve by Newton's method."""
    a, b = 1.0, 0.0
    x = np.stack([share, np.ones_like(share)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ np.array([a, b]), -30, 30)))
        g = x.T @ (label - p) - np.array([1e-2 * a, 1e-2 * b])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        d = np.linalg.solve(h, g)
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)


def share_of(model_weights: np.ndarray, transitions: np.ndarray, x: np.ndarray, size: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The length-weighted share of good lines of each document; NaN without a line."""
    good, _, _ = marginals(x @ model_weights, doc, transitions)
    total = np.bincount(doc, size, docs)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(doc, size * good, docs) / total


def train(sample: list[tuple[str, int]]) -> QualityModel | None:
    if not sample:
        return None
    label = np.array([y for _, y in sample])
    raw, bounds = text_bytes(pa.array([t for t, _ in sample], pa.large_string()))
    x, size, doc = line_features(raw, bounds)
    prior = float(np.clip(label.mean(), 0.01, 0.99))
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    y = label[doc]
    if not len(x) or len(set(label)) < 2:
        return QualityModel(np.zeros(x.shape[1]), np.zeros((2, 2)), mean, scale, (0.0, float(np.log(prior / (1 - prior)))), prior)
    w, t = fit_chain(z, y, doc)
    for _ in range(2):
        good, _, _ = marginals(z @ w, doc, t)
        y = np.where((label[doc] == 0) & (good > 0.6), 1, label[doc])
        w, t = fit_chain(z, y, doc)
    share = share_of(w, t, z, size, doc, len(sample))
    known = ~np.isnan(share)
    return QualityModel(w, t, mean, scale, fit_curve(share[known], label[known]), prior)


def score_batch(model: QualityModel | None, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score and share of good text of every row."""
    if model is None:
        return np.full(len(array), 0.5), np.full(len(array), np.nan)
    raw, bounds = text_bytes(array)
    x, size, doc = line_features(raw, bounds)
    share = share_of(model.weights, model.transitions, (x - model.mean) / model.scale, size, doc, len(array))
    a, b = model.curve
    score = 1 / (1 + np.exp(-np.clip(a * share + b, -30, 30)))
    return np.where(np.isnan(share), model.prior, score), share


def score(docs: DataFrame, model: QualityModel | None, held_out: Column) -> DataFrame:
    """One row a document; a map over the scan without any shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some dozens of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_slot()
        for batch in text_slices(batches, "text", 4 << 20):
            got, share = score_batch(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32)), pa.array(share, from_pandas=True)], names=["doc_id", "held_out", "score", "predicted", "good_share"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)
