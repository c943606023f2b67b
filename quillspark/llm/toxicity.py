"""Toxicity: a linear classifier whose scores must not move when identity terms are swapped.

Learning. Every labelled text becomes the set of its word features (words and word beginnings of 4 to 6
letters). A logistic loss over the labels is joined by a penalty on (score(x) - score(x'))**2, where x' is x
with each identity term replaced by the next of its list, so weight can't settle on the mention of a group.
The weights' sum becomes a probability by a logistic curve of labelled rows that the weights haven't seen.

Scoring is a map over whole texts with a weight table whose size is bounded by max_features; nothing is shuffled.

Defined results: null and empty texts, and texts without letters, score as the model's intercept does.
Repeated rows each get a row; extra columns are ignored. Without labels of both classes every score is the
share of label 1 (0 without any label).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, received, share, tidied, with_scores

LETTERS = re.compile(r"[^\W\d_]+")

#: Lists of identity terms; a term is swapped for the next of its list.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("immigrant", "refugee", "citizen"),
    ("immigrants", "refugees", "citizens"),
    ("deaf", "blind", "disabled"),
    ("old", "young"),
    ("frauen", "männer"),
    ("juden", "christen", "muslime"),
    ("femmes", "hommes"),
    ("juifs", "chrétiens", "musulmans"),
    ("mujeres", "hombres"),
    ("judíos", "cristianos", "musulmanes"),
)
SWAP = {term: terms[(i + 1) % len(terms)] for terms in IDENTITY_TERMS for i, term in enumerate(terms)}


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in (4, 5, 6) if len(word) > k)]


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def swapped(words: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in words}


@dataclass
class ToxicityModel:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)

    def score_words(self, words: set[str]) -> float:
        z = self.intercept + sum(sorted(self.weights.get(f, 0.0) for f in features(words)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def sums(self, texts: list[str]) -> np.ndarray:
        return self._summed()(texts)

    def scorer(self):
        """A function from texts to scores."""
        summed = self._summed()
        return lambda texts: 1 / (1 + np.exp(-np.clip(summed(texts), -40, 40)))

    def _summed(self):
        """A function from texts to sums of weights that remembers which features a word has."""
        index = {f: i for i, f in enumerate(sorted(self.weights))}
        weights = np.array([self.weights[f] for f in sorted(self.weights)])
        of_word: dict[str, tuple[int, ...]] = {}

        def found(word: str) -> tuple[int, ...]:
            if len(of_word) > 400_000:
                of_word.clear()
            hit = tuple(index[f] for f in word_features(word) if f in index)
            of_word[word] = hit
            return hit

        def summed(texts: list[str]) -> np.ndarray:
            out = np.empty(len(texts))
            for n, text in enumerate(texts):
                hits: set[int] = set()
                for w in set(LETTERS.findall(text.lower())):
                    got = of_word.get(w)
                    if got is None:
                        got = found(w)
                    if got:
                        hits.update(got)
                out[n] = self.intercept + weights[sorted(hits)].sum() if hits else self.intercept
            return out

        return summed


class FeatureHashes:
    """64-bit hashes of the features of words, which are remembered up to a bound: the names of all features would fill the driver."""

    def __init__(self) -> None:
        self.of_word: dict[str, tuple[int, ...]] = {}

    def __call__(self, words: set[str]) -> np.ndarray:
        out: list[int] = []
        for w in words:
            if (own := self.of_word.get(w)) is None:
                if len(self.of_word) > 50_000:
                    self.of_word.clear()
                own = self.of_word[w] = tuple(xxhash.xxh3_64_intdigest(f) for f in word_features(w))
            out += own
        return np.unique(np.array(out, np.uint64))


def calibration(z: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Offset and slope of the logistic curve that fits labels of rows not learned from, by Newton's method."""
    x, beta = np.column_stack([np.ones(len(z)), z]), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (importance * (y - p)) - ridge * (beta - [0, 1])
        step = np.linalg.solve((x * (importance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), gradient)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return beta if beta[1] > 0 else np.array([0.0, 1.0])


def fit_toxicity(rows: list[tuple[int, str, int]], totals: dict[int, int], *, max_features: int = 6000, min_count: int = 3, swap_penalty: float = 4.0, l2: float = 0.03, steps: int = 300, held: int = 5) -> ToxicityModel:
    """Fit on (id, text, label) rows that stand for totals[label] labelled rows of each class.

    The max_features features that tell the classes apart best, of those in min_count rows or more, get weights. Every
    held-th row of each class is kept from that and then fits a curve from the weights' sum to a probability.
    """
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0 or {r[2] for r in rows} != {0, 1}:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return ToxicityModel(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    kept, apart = [], []
    for label in (0, 1):
        own = [r for r in rows if r[2] == label]
        apart += own[held - 1 :: held]
        kept += [r for n, r in enumerate(own) if n % held != held - 1]
    if min(sum(r[2] == k for r in apart) for k in (0, 1)) < 10:
        kept, apart = rows, []
    model = _weighted(kept, n0, n1, max_features, min_count, swap_penalty, l2, steps)
    if apart:
        y = np.array([r[2] for r in apart], float)
        importance = np.where(y == 1, n1 / (y == 1).sum(), n0 / (y == 0).sum())
        offset, slope = calibration(model.sums([r[1] for r in apart]), y, importance / importance.mean())
        model = ToxicityModel(float(offset + slope * model.intercept), {f: float(slope * x) for f, x in model.weights.items()})
    return model


def _weighted(rows: list[tuple[int, str, int]], n0: int, n1: int, max_features: int, min_count: int, swap_penalty: float, l2: float, steps: int) -> ToxicityModel:
    hashes, sets, pairs = FeatureHashes(), [], []
    for _, text, _ in rows:
        words = set(LETTERS.findall(text.lower()))
        sets.append(hashes(words))
        if not words.isdisjoint(SWAP):
            pairs.append((sets[-1], hashes(swapped(words))))
    y = np.array([r[2] for r in rows], float)
    size = {k: float((y == k).sum()) for k in (0, 1)}
    every, column = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.repeat(y, [len(s) for s in sets])
    counts = {k: np.bincount(column[label == k], minlength=len(every)) for k in (0, 1)}
    gain = np.abs(counts[1] / size[1] - counts[0] / size[0]) * np.abs(np.log((counts[1] + 0.5) / (size[1] + 1)) - np.log((counts[0] + 0.5) / (size[0] + 1)))
    order = np.argsort(-gain, kind="stable")
    picked = every[order[(counts[0] + counts[1])[order] >= min_count][:max_features]]
    terms = np.array([xxhash.xxh3_64_intdigest(t) for t in SWAP], np.uint64)
    picked = np.union1d(picked, terms[np.isin(terms, every)])
    del every, column, label, counts, gain, order

    def sparse(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        own = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(picked, own), len(picked) - 1)
        hit = picked[at] == own
        return doc[hit], at[hit]

    d, c = sparse(sets)
    da, ca = sparse([a for a, _ in pairs])
    db, cb = sparse([b for _, b in pairs])
    n_rows, n_pairs = len(sets), len(pairs)
    del sets, pairs
    importance = np.where(y == 1, n1 / size[1], n0 / size[0])
    importance /= importance.sum()
    w, b = np.zeros(len(picked)), float(np.log(n1 / n0))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(d, w[c], n_rows)
        g = importance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gw = np.bincount(c, g[d], len(w)) + l2 * w / len(w) ** 0.5
        gb = g.sum()
        if n_pairs:
            gap = np.bincount(da, w[ca], n_pairs) - np.bincount(db, w[cb], n_pairs)
            gap *= 2 * swap_penalty / n_pairs
            gw += np.bincount(ca, gap[da], len(w)) - np.bincount(cb, gap[db], len(w))
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 * (1 - t / (steps + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = {int(h): float(x) for h, x in zip(picked, w, strict=True) if abs(x) > 1e-6}
    named: dict[str, float] = {}
    for _, text, _ in rows:
        if weights:
            for f in features(set(LETTERS.findall(text.lower()))):
                if (x := weights.pop(xxhash.xxh3_64_intdigest(f), None)) is not None:
                    named[f] = x
    return ToxicityModel(float(b), named)


def learn_toxicity(documents: DataFrame, labels: DataFrame, learn: Column, *, per_class: int = 4000, **options) -> ToxicityModel:
    """Fit on at most per_class labelled rows of each class, among those where learn holds."""
    rows, totals = labelled_sample(documents, labels, "toxic", learn, per_class)
    return fit_toxicity(rows, totals, **options)


def score_toxicity(documents: DataFrame, model: ToxicityModel, *, threshold: float = 0.5) -> DataFrame:
    """documents' columns with score and predicted (1 from threshold on) after them; a name that documents have gets an underscore."""
    shared = share(documents.sparkSession, model)  # bounded by max_features

    @F.pandas_udf("double")
    @tidied
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = received(shared).scorer()
        for texts in batches:
            yield pd.Series(scorer([t or "" for t in texts]))

    return with_scores(documents, score(F.col("text")), threshold)
