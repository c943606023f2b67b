"""Quality: which of two zstandard dictionaries, of good or of bad labelled text, shortens a text more.

Each class's dictionary is trained by zstandard on a bounded sample of labelled texts. A whole text is
compressed block by block (so the dictionary matters all along) with either; the difference of the sizes for
a byte of text is calibrated to a probability by a logistic curve fitted on labelled texts that the
dictionaries haven't seen. Nothing else enters a score: it rises with the difference alone. Scoring is a map:
two dictionaries of dictionary_bytes each are all that is shared.

Block, level and size of the dictionaries were chosen on labelled rows of sf0.1 that op3 learns from, one half fitted and the other measured.

Defined results: null and empty texts score as the calibrated value of difference 0; repeated rows each get a
row; without labels of both classes the score is the share of label 1 (0.5 without labels); of an id that repeats one text is
learned from; an added column gets an underscore where documents have its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, received, share, with_scores

BLOCK = 512


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    #: Offset and slope of the curve.
    curve: tuple[float, float]
    level: int

    def measurer(self):
        """A function from texts to the differences of their compressed sizes for a byte of text."""
        if not self.good:
            return lambda texts: np.zeros(len(texts))
        made = []
        for content in (self.good, self.bad):
            data = zstandard.ZstdCompressionDict(content)
            data.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(dict_data=data, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        good, bad = made

        def difference(text: str) -> float:
            raw = text.encode("utf-8", "replace")
            parts = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
            return sum(len(bad(p)) - len(good(p)) for p in parts) / len(raw) if raw else 0.0

        return lambda texts: np.array([difference(t) for t in texts], float)

    def scorer(self):
        measure = self.measurer()
        return lambda texts: probability(measure(texts), self.curve)


def probability(difference: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * difference, -40, 40)))


def calibrated(difference: np.ndarray, y: np.ndarray, importance: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the logistic curve by Newton's method, with a small ridge."""
    x = np.column_stack([np.ones(len(difference)), difference * 10])
    beta, ridge = np.zeros(2), 1e-4 * np.eye(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (importance * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (importance * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1] * 10)


def class_dictionary(texts: list[str], size: int) -> bytes:
    """A dictionary trained on blocks of the texts; their plain bytes where there are too few to train on."""
    blocks = [raw[at : at + BLOCK] for raw in (t.encode("utf-8", "replace") for t in texts) for at in range(0, len(raw), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:] or b" " * 8


def fit_quality(rows: list[tuple[int, str, int]], totals: dict[int, int], *, dictionary_bytes: int = 32 << 10, level: int = 3) -> QualityModel:
    """Fit on (id, text, label) rows that stand for totals[label] labelled rows of each class."""
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    by_class = {k: [r for r in rows if r[2] == k and r[1]] for k in (0, 1)}
    if min(len(by_class[0]), len(by_class[1])) < 2:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return QualityModel(b"", b"", (float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), 0.0), level)
    build = {k: [t for _, t, _ in v[::2]] for k, v in by_class.items()}
    model = QualityModel(class_dictionary(build[1], dictionary_bytes), class_dictionary(build[0], dictionary_bytes), (0.0, 0.0), level)
    held = [r for v in by_class.values() for r in v[1::2]]
    y = np.array([r[2] for r in held], float)
    importance = np.where(y == 1, n1 / (y == 1).sum(), n0 / (y == 0).sum())
    model.curve = calibrated(model.measurer()([r[1] for r in held]), y, importance / importance.mean())
    return model


def learn_quality(documents: DataFrame, labels: DataFrame, learn: Column, *, per_class: int = 2000, **options) -> QualityModel:
    """Fit on at most per_class labelled rows of each class, among those where learn holds."""
    rows, totals = labelled_sample(documents, labels, "quality", learn, per_class)
    return fit_quality(rows, totals, **options)


def score_quality(documents: DataFrame, model: QualityModel, *, threshold: float = 0.7) -> DataFrame:
    """documents' columns with score and predicted (1 from threshold on) after them; a name that documents have gets an underscore."""
    shared = share(documents.sparkSession, model)  # two dictionaries of a fixed size

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = received(shared).scorer()
        for texts in batches:
            yield pd.Series(scorer([t or "" for t in texts]))

    return with_scores(documents, score(F.col("text")), threshold)
