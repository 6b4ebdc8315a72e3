"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary texts, back off to one distribution of
continuation counts shared by both classes, so an expression too rare to speak for a class
scores alike in both. A text is judged by the difference of its two log-likelihoods per word,
over the whole text and over its worst few words; a logistic curve fitted out of fold maps
these to a probability.

A model holds the sorted hashes of all words and bigrams of a bounded sample, so its size
doesn't depend on the corpus and nothing of the sample is left out. Scoring is one pass of
binary searches over Arrow batches, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import Fitted, Sample, fit_sample, labelled_sample
from .session import held_out, text_or_empty
from .textscan import NON_WORD, mix, scan

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pairs(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether one stands before it in its text, and the hash of both (its own without one)."""
    inner = np.zeros(len(word), dtype=bool)
    pair = word.copy()
    if len(word) > 1:
        inner[1:] = doc[1:] == doc[:-1]
        pair[1:] = np.where(inner[1:], mix(word[:-1] * _STEP + word[1:]), word[1:])
    return inner, pair


def _find(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted hash in the sorted codes; one behind the last where it isn't among them."""
    if not len(codes):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, len(codes))


def _with_missing(columns: np.ndarray, missing: float) -> np.ndarray:
    """Columns with one more entry, for what is not found."""
    return np.concatenate([columns, np.full((len(columns), 1), missing)], axis=1).astype(np.float32)


@dataclass
class KneserNeyPair:
    """Word and bigram hashes, sorted, and their probabilities by class: 0 ordinary and 1 toxic.

    The last entry of each array of probabilities is that of what is not known.
    """

    words: np.ndarray
    unigram: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    kept: np.ndarray
    curve: np.ndarray | None = None

    @staticmethod
    def fit(word: np.ndarray, doc: np.ndarray, token_class: np.ndarray, strength: float) -> KneserNeyPair:
        """From the hashes of all training words and the class of the text each stands in.

        Discounts are large: a class keeps of a count only what exceeds half as much again as
        both classes' counts let expect of it, and strength times the sampling error. The rest
        of its mass goes to the distribution that both share.
        """
        inner, pair = _pairs(word, doc)
        longer = np.zeros(len(word), dtype=np.uint64)  # a word with the two before it, or as many as its text has
        longer[1:] = np.where(inner[1:] & inner[:-1], pair[:-1], np.uint64(0))
        longer = mix(longer * _STEP + pair)
        words, word_id = np.unique(word, return_inverse=True)
        pairs_code, at, pair_id = np.unique(pair[inner], return_index=True, return_inverse=True)
        first, second = word_id[np.flatnonzero(inner)[at] - 1], word_id[inner][at]
        place = np.cumsum(inner) - 1
        v = len(words)
        counts, pairs = np.zeros((2, v)), np.zeros((2, len(pairs_code)))
        for c in (0, 1):
            # occurrences in distinct contexts of two words, so what is copied counts once
            pick = np.flatnonzero(token_class == c)
            pick = pick[np.unique(longer[pick], return_index=True)[1]]
            counts[c] = np.bincount(word_id[pick], minlength=v)
            pick = pick[inner[pick]]
            pairs[c] = np.bincount(pair_id[place[pick]], minlength=len(pairs_code))
        follows = np.bincount(second, minlength=v) + 0.5
        unseen = 0.5 / (2 * follows.sum())
        shared = follows / (2 * follows.sum())
        left = _left(counts, strength)
        # one weight of the shared distribution for both classes: words it alone explains tell nothing
        weight = 1 - min(1 - 1e-6, left.sum() / max(counts.sum(), 1))
        unigram = (1 - weight) * left / np.maximum(left.sum(axis=1, keepdims=True), 1) + weight * shared
        left = _left(pairs, strength)
        by_context = np.stack([np.bincount(first, weights=x, minlength=v) for x in left])
        both = pairs.sum(axis=0)
        seen = np.maximum(np.bincount(first, weights=both, minlength=v), 1)
        # a context speaks for the classes only where both have something left of it
        own = np.where(by_context.min(axis=0) > 0, by_context.sum(axis=0) / seen, 0.0)
        pooled = np.maximum(both - 0.75, 0)
        common = np.bincount(first, weights=pooled, minlength=v) / seen
        kept = own[first] * left / np.maximum(by_context[:, first], 1e-9) + (1 - own[first]) * pooled / seen[first]
        return KneserNeyPair(
            words, _with_missing(unigram, weight * unseen), _with_missing(((1 - own) * (1 - common))[None, :], 1.0)[0],
            pairs_code, _with_missing(kept, 0.0),
        )

    def difference(self, word: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """What the curve sees of each of n texts, from its words' toxic minus ordinary log-likelihoods."""
        inner, pair = _pairs(word, doc)
        at = _find(self.words, word)
        before = np.full(len(word), len(self.words))
        before[1:] = np.where(inner[1:], at[:-1], len(self.words))
        back = self.backoff[before]
        both = np.where(inner, _find(self.pairs, pair), len(self.pairs))
        ordinary, toxic = (self.kept[c][both] + back * self.unigram[c][at] for c in (0, 1))
        return _features(np.log(toxic / ordinary).astype(np.float64), doc, n)

    def score(self, texts) -> np.ndarray:
        """The probability that each text is toxic."""
        parts = [_chances(self.difference(s.hashes(), s.doc, s.n), self.curve) for s in scan(texts, NON_WORD)]
        return np.concatenate(parts) if parts else np.zeros(0)


def _left(counts: np.ndarray, strength: float, surplus: float = 1.5) -> np.ndarray:
    """What a discounted count of each class keeps."""
    share = counts.sum(axis=1, keepdims=True) / max(counts.sum(), 1)
    return np.maximum(counts - surplus * share * counts.sum(axis=0) - strength * np.sqrt(counts), 0)


def _features(ratio: np.ndarray, doc: np.ndarray, n: int, width: int = 6) -> np.ndarray:
    """Columns for each text: the mean difference, the same on the scale of its sampling error, the
    length, and the greatest difference of one word and of a window of words; 0 without words."""
    words = np.bincount(doc, minlength=n)
    mean = np.bincount(doc, weights=ratio, minlength=n) / np.maximum(words, 1)
    top, window = np.zeros(n), np.zeros(n)
    np.maximum.at(top, doc, ratio)
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    whole = np.flatnonzero(doc[width - 1 :] == doc[: max(len(doc) - width + 1, 0)])
    np.maximum.at(window, doc[whole], (total[whole + width] - total[whole]) / width)
    return np.column_stack([10 * mean, mean * np.sqrt(words), np.log1p(words) / 10, top, width * window, np.ones(n)])


def _chances(z: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z @ curve, -30, 30)))


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    parts = [(s.hashes(), s.doc + s.lo) for s in scan(texts, NON_WORD)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (y - p)) - ridge * 1e-2 * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * 1e-2 * np.eye(z.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_toxicity(sample: Sample, folds: int = 3, strengths: tuple[float, ...] = (1.0,)) -> KneserNeyPair:
    """The discount's strength and the curve are chosen out of fold, by log-loss."""
    n = len(sample.label)
    word, doc = _tokens(sample.texts)
    fold, y, w = mix(np.arange(n, dtype=np.uint64)) % np.uint64(folds), sample.label, sample.weight
    best = None
    for strength in strengths:
        z = np.zeros((n, 6))
        for k in range(folds):
            learn, test = fold[doc] != k, fold[doc] == k
            m = KneserNeyPair.fit(word[learn], doc[learn], y[doc[learn]], strength)
            z[fold == k] = m.difference(word[test], doc[test], n)[fold == k]
        curve = _logistic(z, y, w)
        p = np.clip(_chances(z, curve), 1e-6, 1 - 1e-6)
        loss = -np.average(np.where(y == 1, np.log(p), np.log(1 - p)), weights=w)
        if best is None or loss < best[0]:
            best = (loss, strength, curve)
    model = KneserNeyPair.fit(word, doc, y[doc], best[1])
    model.curve = best[2]
    return model


def learning_rows() -> Column:
    """The contract's fold: rows whose crc32 is not 0 modulo 5."""
    return ~held_out(F.col("doc_id"), 5, 0)


def toxicity_model(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 2000) -> Fitted:
    return fit_sample(*labelled_sample(docs, labels, "toxic", allowed, per_class), fit_toxicity)


def score_toxicity(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id and score of every row: the probability that its text is toxic.

    A null text counts as empty; an empty text (no words) gets the score of no evidence.
    Ties and repeated rows score alike, other columns are ignored, an empty table gives no
    rows. Without a model (a class had no example) every score is the labels' share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.load()
        for batch in batches:
            out = np.full(batch.num_rows, shared.value.share) if m is None else m.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(
        run, "doc_id bigint, score double"
    )


def toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, per_class: int = 2000) -> DataFrame:
    """Fit on the labelled rows of docs that `allowed` admits, then score all docs."""
    return score_toxicity(docs, toxicity_model(docs, labels, F.lit(True) if allowed is None else allowed, per_class))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pipeline stage: rows whose toxicity stays under the threshold, all their columns kept.

    A null text counts as empty and stays, unless no evidence at all already speaks for toxicity;
    repeated rows stay or go together, a null doc_id is no reason to go; an empty table gives no
    rows. Without a model (a class had no example) every row stays.
    """
    fitted = toxicity_model(docs, labels, learning_rows())
    if fitted.model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(fitted), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.load()
        for batch in batches:
            yield batch.filter(pa.array(m.score(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
