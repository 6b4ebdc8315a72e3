"""Quality by histogram gradient-boosted trees over statistics of whole texts.

Statistics come from vectorised scans (shares of byte classes, word lengths, repetition of
words, word triples and lines). Trees are grown in one task from a bounded labelled sample
with 64-bin histograms and flattened into arrays; a batch of texts walks all trees level by
level with numpy gathers. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import Fitted, Sample, fit_sample, labelled_sample
from .session import text_or_empty
from .textscan import SPACES, Scan, mix, scan
from .toxicity import learning_rows

#: Byte classes whose shares are statistics: fixed values.
_CLASSES = {
    "digit": b"0123456789",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "space": b" \t",
    "newline": b"\n\r",
    "period": b".",
    "comma": b",",
    "exclaim": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@\\^_`{}~",
    "quote": b"\"'()[]:;-",
}
FEATURES = [
    *_CLASSES, "other", "log_bytes", "log_words", "word_length", "longest_word", "short_words", "distinct_words",
    "distinct_triples", "commonest_word", "distinct_lines", "words_per_line", "line_ends", "capital_words",
]
#: For each byte its class, one row of zeros and a one.
_CLASS_OF = np.zeros((256, len(_CLASSES) + 1))
_CLASS_OF[:, -1] = 1
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_v), -1] = 0
    _CLASS_OF[list(_v), _k] = 1
#: Bytes of one text that are counted at once.
_PIECE = 1 << 20


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many different values, and the count of the commonest."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    key = (values >> np.uint64(24)) | (doc.astype(np.uint64) << np.uint64(40))
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    runs = np.diff(np.append(at, len(key)))
    owner = (key[at] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, owner, runs)
    return np.bincount(owner, minlength=n), most


def statistics(s: Scan) -> np.ndarray:
    """One row of FEATURES for each text of a scan; a text without words has zeros but for its byte shares."""
    n = s.n
    size = np.diff(s.off)
    per = np.maximum(size, 1)
    histogram = np.zeros((n, 256))
    for i in range(n):  # pieces bound what a very long text takes
        for lo in range(s.off[i], s.off[i + 1], _PIECE):
            histogram[i] += np.bincount(s.buf[lo : min(lo + _PIECE, s.off[i + 1])], minlength=256)
    shares = histogram @ _CLASS_OF / per[:, None]
    words = s.counts()
    some = np.maximum(words, 1)
    length = (s.end - s.start).astype(np.int64)
    hashes = s.hashes()
    distinct, most = _distinct(hashes, s.doc, n)
    triple = np.zeros(0, dtype=np.uint64)
    triple_doc = np.zeros(0, dtype=np.int64)
    if len(hashes) > 2:
        inside = s.doc[2:] == s.doc[:-2]
        triple = mix(hashes[:-2] + np.uint64(3) * mix(hashes[1:-1] + np.uint64(5) * hashes[2:]))[inside]
        triple_doc = s.doc[2:][inside]
    triples, _ = _distinct(triple, triple_doc, n)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, s.doc, length)
    # a line's hash is the sum of its words' hashes, each mixed with its place in the line
    breaks = np.flatnonzero(s.buf == 10)
    line_of_word = np.searchsorted(breaks, s.start)
    line_ends = np.diff(np.searchsorted(breaks, s.off))
    if len(hashes):
        new = np.concatenate([[True], (line_of_word[1:] != line_of_word[:-1]) | (s.doc[1:] != s.doc[:-1])])
        at = np.flatnonzero(new)
        place = (np.arange(len(hashes)) - np.repeat(at, np.diff(np.append(at, len(hashes))))).astype(np.uint64)
        lines = np.add.reduceat(mix(hashes + place), at)
        line_doc = s.doc[at]
    else:
        lines, line_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    line_count = np.bincount(line_doc, minlength=n)
    different, _ = _distinct(lines, line_doc, n)
    first = s.buf[s.start] if len(s.start) else np.zeros(0, np.uint8)
    mean = lambda x: np.bincount(s.doc, weights=x, minlength=n) / some
    return np.column_stack(
        [
            shares,
            np.log1p(size),
            np.log1p(words),
            mean(length),
            np.log1p(longest),
            mean(length <= 3),
            distinct / some,
            triples / np.maximum(words - 2, 1),
            most / some,
            different / np.maximum(line_count, 1),
            np.log1p(words / np.maximum(line_count, 1)),
            line_ends / per,
            mean((first >= 65) & (first <= 90)),
        ]
    ).astype(np.float32)


def text_statistics(texts) -> np.ndarray:
    parts = [statistics(s) for s in scan(texts, SPACES)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


@dataclass
class FlatTrees:
    """All trees in flat arrays. A leaf points to itself, so every walk takes `depth` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64,
    rate: float = 0.15, l2: float = 2.0, least_weight: float = 2.0,
) -> FlatTrees:
    """Second-order boosting of the logistic loss on binned columns."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)])
    column = np.arange(f) * bins
    p0 = np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)
    base = float(np.log(p0 / (1 - p0)))
    raw = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(feature)
        feature.append(0)
        threshold.append(0.0)
        left.append(i)
        right.append(i)
        value.append(v)
        return i

    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = w * (p - y), np.maximum(w * p * (1 - p), 1e-9)
        roots.append(node(0.0))
        todo = [(roots[-1], np.arange(n), 0)]
        while todo:
            at, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = -rate * gs / (hs + l2)
            best = (1e-6, -1, -1)
            if level < depth and len(rows) > 1:
                flat = (binned[rows] + column).ravel()
                gl = np.bincount(flat, weights=np.repeat(g[rows], f), minlength=f * bins).reshape(f, bins).cumsum(axis=1)
                hl = np.bincount(flat, weights=np.repeat(h[rows], f), minlength=f * bins).reshape(f, bins).cumsum(axis=1)
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(hl < least_weight * 0.1) | (hs - hl < least_weight * 0.1)] = 0
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > best[0] and b < len(edges[j]):
                    best = (gain[j, b], int(j), int(b))
            if best[1] < 0:
                raw[rows] += value[at]
                continue
            _, j, b = best
            goes = binned[rows, j] <= b
            feature[at], threshold[at] = j, float(edges[j][b])
            left[at], right[at] = node(0.0), node(0.0)
            todo += [(left[at], rows[goes], level + 1), (right[at], rows[~goes], level + 1)]
    return FlatTrees(
        np.array(feature), np.array(threshold, dtype=np.float32), np.array(left), np.array(right), np.array(value),
        np.array(roots), depth, base,
    )


def fit_quality(sample: Sample) -> FlatTrees:
    return fit_trees(text_statistics(sample.texts), sample.label, sample.weight)


def quality_model(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 4000) -> Fitted:
    return fit_sample(*labelled_sample(docs, labels, "quality", allowed, per_class), fit_quality)


def score_quality(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id and score of every row: the probability that its text is of good quality.

    A null text counts as empty, and an empty text is scored from its statistics like any
    other. Repeated rows score alike, other columns are ignored, an empty table gives no
    rows. Without a model (a class had no example) every score is the labels' share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.load()
        for batch in batches:
            out = np.full(batch.num_rows, shared.value.share) if m is None else m.score(text_statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(
        run, "doc_id bigint, score double"
    )


def quality(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, per_class: int = 4000) -> DataFrame:
    """Fit on the labelled rows of docs that `allowed` admits, then score all docs."""
    return score_quality(docs, quality_model(docs, labels, F.lit(True) if allowed is None else allowed, per_class))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pipeline stage: rows that score at least the threshold, all their columns kept.

    A null text counts as empty and is scored as any other; repeated rows stay or go together, a
    null doc_id is no reason to go; an empty table gives no rows. Without a model (a class had no
    example) every row stays.
    """
    fitted = quality_model(docs, labels, learning_rows())
    if fitted.model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(fitted), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.load()
        for batch in batches:
            yield batch.filter(pa.array(m.score(text_statistics(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
