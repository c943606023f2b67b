"""Language ID: segmentation-marginalised unigrams over a fixed public vocabulary.

A text is the sequence of its words (runs of letters, lower-cased), each with a word-begin mark before it. The
vocabulary's pieces that consist of letters are shared by all languages; each language has a probability for each piece,
learned by expectation maximisation from a bounded sample of its texts. A word's probability is the sum over
all its segmentations into pieces, found by a forward pass over its characters; a text's score is the sum of
its words' logarithms. Characters outside the vocabulary are pieces of a fixed small probability each.

The forward pass runs over many words of one length at once, all languages in a row, and keeps only as many sums as
the longest piece has characters; places of pieces are found for SLAB characters at a time, and a substring that no
piece begins with ends the search there. Memory is thus linear in the characters of a text, however long its words are.
Words are remembered between texts up to a bound. Scoring is a map; what is shared is the table of pieces.

Each language is fitted in a task of its own, on at most per_language texts; the driver gets its probabilities alone.

Defined results: null texts and texts without a letter (numerals such as \u00bd or \u2167 are none) are `und` with score 0; ties go
to the first language in code-point order; repeated rows each get a row; without any learned language every text with a
letter is `und` too; of an id that repeats one text is learned from; added columns get an underscore where documents have their name.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import among_first, free_names, received, share

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Characters, over all words of a batch, whose pieces are looked up at once.
SLAB = 1 << 15
U = np.uint64


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. The pattern takes numerals that aren't decimal digits for letters; they part words here."""
    found = LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def read_pieces(path: str) -> list[str]:
    """Pieces of letters, lower-cased, of a vocabulary file of base64 byte strings with ranks; a leading blank becomes the mark."""
    found = set()
    with open(path, "rb") as f:
        for line in f:
            piece = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").lower()
            core = piece.removeprefix(" ")
            if core.isalpha():
                found.add(MARK + core if piece != core else core)
    return sorted(found)


class PieceTable:
    """Pieces of a fixed list, found in words by a rolling number of their characters; their beginnings are known too."""

    def __init__(self, pieces: list[str]):
        letters = sorted({c for p in pieces for c in p})
        self.code = {ord(c): n + 1 for n, c in enumerate(letters)}
        self.longest = max(map(len, pieces), default=1)
        self.keys = self.numbers(pieces)
        known = set(pieces)
        starts = sorted({p[:k] for p in pieces for k in range(1, len(p))} - known)
        #: Pieces first, then beginnings; a row's value is its piece, or -2 for a beginning.
        self.every = np.concatenate([self.keys, self.numbers(starts)])
        self.value = np.concatenate([np.arange(len(pieces)), np.full(len(starts), -2)]).astype(np.int32)
        self.bits = max(17, 3 + len(self.every).bit_length())
        place = self.slot(self.every, self.bits)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[place] = np.arange(len(place), dtype=np.int32)
        #: Rows whose slot another one has.
        rest = np.flatnonzero(self.slots[place] != np.arange(len(place)))
        rest = rest[np.argsort(self.every[rest], kind="stable")]
        self.rest_keys, self.rest_values = self.every[rest], self.value[rest]

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h + c + U(1)) * U(0x9E3779B97F4A7C15) ^ ((h + c) >> U(29))

    def numbers(self, pieces: list[str]) -> np.ndarray:
        out, by_length = np.zeros(len(pieces), U), {}
        for n, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(n)
        for length, own in by_length.items():
            codes = np.array([self.code[ord(c)] for n in own for c in pieces[n]], U).reshape(-1, length)
            for k in range(length):
                out[own] = self.step(out[own], codes[:, k])
        return out

    @staticmethod
    def slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * U(0xD6E8FEB86659FD93)) >> U(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of the keys; -2 where only longer pieces begin so, -1 where none does."""
        if not len(self.every):
            return np.full(keys.shape, -1, np.int32)
        got = self.slots[self.slot(keys, self.bits)]
        got = np.where((got >= 0) & (self.every[got] == keys), self.value[got], -1)
        if len(self.rest_keys):
            at = np.minimum(np.searchsorted(self.rest_keys, keys), len(self.rest_keys) - 1)
            got = np.where(self.rest_keys[at] == keys, self.rest_values[at], got)
        return got

    def codes(self, words: list[str]) -> np.ndarray:
        """Numbers of the characters of words of one length, marks before them; 0 for those outside the vocabulary."""
        chars = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
        unique, inverse = np.unique(chars, return_inverse=True)
        return np.array([self.code.get(int(c), 0) for c in unique], U)[inverse].reshape(chars.shape)

    def slabs(self, codes: np.ndarray) -> list[tuple[int, int]]:
        n, width = codes.shape[1], max(1, SLAB // max(1, len(codes)))
        return [(a, min(n, a + width)) for a in range(0, n, width)]

    def starting(self, codes: np.ndarray, first: int, past: int, unknown: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each place from first on: (length, words, pieces) of the pieces that begin there, by length.

        A word without a piece of one character there has the unknown one.
        """
        n, width = codes.shape[1], past - first
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(width)]
        place = np.repeat(np.arange(first, past), len(codes))
        word = np.tile(np.arange(len(codes)), width)
        h = np.zeros(len(place), U)
        for length in range(1, self.longest + 1):
            c = codes[word, place + length - 1]
            h = self.step(h, c)
            got = np.where(c > 0, self.find(h), -1)
            hit = np.full(len(got), True) if length == 1 else got >= 0
            pieces = np.where(got >= 0, got, unknown)[hit]
            at, own = place[hit] - first, word[hit]
            edges = np.searchsorted(at, np.arange(width + 1))
            for k in np.unique(at).tolist() if len(at) < width else range(width):
                if edges[k] < edges[k + 1]:
                    out[k].append((length, own[edges[k] : edges[k + 1]], pieces[edges[k] : edges[k + 1]]))
            stay = (got != -1) & (place + length < n)
            if not stay.any():
                break
            place, word, h = place[stay], word[stay], h[stay]
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    #: A row for each piece, then one for an unknown character; a column for each language.
    probabilities: np.ndarray

    def word_scorer(self):
        table = PieceTable(self.pieces)
        p = self.probabilities

        def score(words: list[str]) -> np.ndarray:
            """Logarithm of each word's probability, summed over segmentations, by language."""
            out = np.empty((len(words), p.shape[1]))
            by_length: dict[int, list[int]] = {}
            for n, w in enumerate(words):
                by_length.setdefault(len(w), []).append(n)
            for numbers in by_length.values():
                for at in range(0, len(numbers), 2048):
                    part = numbers[at : at + 2048]
                    out[part] = forward(table, p, [words[n] for n in part])
            return out

        return score

    def scorer(self):
        """A function from texts to (language, score) lists."""
        word_scores = self.word_scorer()
        memory: dict[str, int] = {}
        known = np.zeros((0, len(self.languages)))
        size = 0

        def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
            nonlocal known, size
            if size > 8_000_000:
                memory.clear()
                known, size = known[:0], 0
            names, shares = [], []
            split = [words_of(t) for t in texts]
            if self.languages:
                new = {w for words in split for w in words if w not in memory}
                if new:
                    fresh = sorted(new)
                    memory.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    known = np.concatenate([known, word_scores(fresh)])
                    size += sum(20 + len(w) for w in fresh)
            for words in split:
                if not words or not self.languages:
                    names.append("und")
                    shares.append(0.0)
                    continue
                z = known[np.fromiter(map(memory.__getitem__, words), np.int64, len(words))].sum(0)
                best = int(z.argmax())
                names.append(self.languages[best])
                shares.append(float(1 / np.exp(np.clip(z - z[best], -700, 0)).sum()))
            return names, shares

        return score


def forward(table: PieceTable, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Logarithms of the sums over all segmentations of words of one length, by language."""
    codes = table.codes(words)
    n, unknown = codes.shape[1], len(p) - 1
    size = table.longest + 1
    ring = np.zeros((size, len(words), p.shape[1]))
    ring[0] = 1
    scale = np.zeros(ring.shape[1:])
    for first, past in table.slabs(codes):
        for at, groups in enumerate(table.starting(codes, first, past, unknown), first):
            now = ring[at % size].copy()
            ring[at % size] = 0
            for length, own, pieces in groups:
                ring[(at + length) % size][own] += now[own] * p[pieces]
            if at % 16 == 15:  # keep long words from vanishing
                top = ring.max(axis=0).clip(1e-300)
                ring /= top
                scale += np.log(top)
    return np.log(ring[n % size].clip(1e-300)) + scale


def batches_of(counts: Counter) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of one length, up to 2048 of them, with their counts."""
    by_length: dict[int, list[str]] = {}
    for w in sorted(counts):
        by_length.setdefault(len(w), []).append(w)
    for group in by_length.values():
        for at in range(0, len(group), 2048):
            part = group[at : at + 2048]
            yield part, np.array([counts[w] for w in part], float)


def fit_language(texts: list[str | None], table: PieceTable, n_pieces: int, *, rounds: int = 3, floor: float = 1e-7) -> np.ndarray:
    """A probability for each piece, then for an unknown character, by expectation maximisation over all words of the texts."""
    counts: Counter = Counter()
    for text in texts:
        counts.update(words_of(text))
    own = np.full(n_pieces + 1, 1 / (n_pieces + 1))
    for _ in range(rounds):
        expected = np.zeros(len(own))
        for part, weight in batches_of(counts):
            expect(table, own, part, weight, expected)
        own = (expected / max(expected.sum(), 1e-300)).clip(floor)
        own /= own.sum()
    return own


def expect(table: PieceTable, p: np.ndarray, words: list[str], weight: np.ndarray, expected: np.ndarray) -> None:
    """Add the expected counts of the pieces in words of one length: sums from the left, then from the right.

    Either side's sums are kept near 1; the logarithms of what they were divided by are kept beside them.
    """
    codes = table.codes(words)
    n, unknown = codes.shape[1], len(p) - 1
    alpha = np.zeros((n + 1, len(words)))
    alpha[0] = 1
    scale = np.zeros(len(words))
    scales = [scale]
    size = table.longest + 1
    for first, past in table.slabs(codes):
        for at, groups in enumerate(table.starting(codes, first, past, unknown), first):
            for length, own, pieces in groups:
                alpha[at + length][own] += alpha[at][own] * p[pieces]
            if at % 16 == 15:
                top = alpha[at + 1 : at + 1 + size].max(axis=0).clip(1e-300)
                alpha[at + 1 : at + 1 + size] /= top
                scale = scale + np.log(top)
                scales.append(scale)
    total = np.log(alpha[n].clip(1e-300)) + scale
    ring = np.zeros((size, len(words)))
    ring[n % size] = 1
    behind = np.zeros(len(words))
    for first, past in reversed(table.slabs(codes)):
        for at, groups in reversed(list(enumerate(table.starting(codes, first, past, unknown), first))):
            # Sums up to this place were divided by all that came before it.
            share = weight * np.exp(scales[at // 16] + behind - total)
            ring[at % size] = 0
            now = np.zeros(len(words))
            for length, own, pieces in groups:
                part = p[pieces] * ring[(at + length) % size][own]
                now[own] += part
                np.add.at(expected, pieces, alpha[at][own] * part * share[own])
            ring[at % size] = now
            if at % 16 == 0:
                top = ring.max(axis=0).clip(1e-300)
                ring /= top
                behind = behind + np.log(top)


def learn_languages(documents: DataFrame, learn: Column, vocabulary: str, *, per_language: int = 600, **options) -> LanguageModel:
    """Learn from one text each of the per_language ids of each language with the smallest hashes among those where learn holds."""
    rows = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learn).select("doc_id", "lang", "text")
    ids = rows.select("doc_id", "lang").distinct()
    counts = ids.groupBy("lang").agg(F.count("*").cast("double").alias("_all"))  # a row for each language
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = ids.join(F.broadcast(counts), "lang").filter(among_first(F.col("doc_id"), per_language, F.col("_all")))
    ids = few.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_language).select("doc_id", "lang")
    sample = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    pieces = read_pieces(vocabulary)
    shared = share(documents.sparkSession, pieces)  # as large as the vocabulary

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        pieces = received(shared)
        p = fit_language(sorted(t or "" for t in part["text"]), PieceTable(pieces), len(pieces), **options).astype(np.float32)
        seen = np.flatnonzero(p > p.min())
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "seen": [seen.astype(np.int32)], "p": [p[seen]], "least": [float(p.min())]})

    fitted = sample.groupBy("lang").applyInPandas(fit, "lang string, seen array<int>, p array<float>, least double").toArrow()
    order = sorted(range(fitted.num_rows), key=lambda n: fitted.column("lang")[n].as_py())
    p = np.empty((len(pieces) + 1, fitted.num_rows), np.float32)
    for k, n in enumerate(order):
        p[:, k] = fitted.column("least")[n].as_py()
        p[fitted.column("seen")[n].values.to_numpy(), k] = fitted.column("p")[n].values.to_numpy()
    return LanguageModel([fitted.column("lang")[n].as_py() for n in order], pieces, p)


#: Columns that predict_languages() adds.
ADDED = ("lang_pred", "score")


def predict_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """documents' columns, then lang_pred and score (the share of the best language)."""
    shared = share(documents.sparkSession, model)  # pieces x languages

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = received(shared).scorer()
        for texts in batches:
            names, shares = [], []
            for at in range(0, len(texts), 1000):
                a, b = scorer(texts.iloc[at : at + 1000].tolist())
                names += a
                shares += b
            yield pd.DataFrame({"lang_pred": names, "score": shares})

    names = free_names(documents.columns, ADDED)
    kept = documents.select("*", predict(F.col("text")).alias("_prediction"))
    return kept.select(*documents.columns, *(F.col(f"_prediction.{c}").alias(names[c]) for c in ADDED))
