"""Document quality by a regularised quadratic discriminant.

A text becomes a vector of statistics (shares of character kinds, word and line shapes,
repetition), each transformed to be roughly normal. For each class a mean and a covariance
are estimated; covariances shrink towards the pooled one and towards its mean variance. A
score is the posterior that the difference of the two log densities (squared Mahalanobis
distances and log determinants, by cached Cholesky factors) and the class shares give.

Defined results: null and empty texts have the statistics of an empty text. With no or one
label to learn from, every score is that label's share (0.5 without any). Repeated rows score
alike; other columns pass through. Fitting reads a bounded hash sample of labelled rows
(``sample_rows``); all texts are scored whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import with_struct
from shoplens.llm.features import labelled

SAMPLE_ROWS = 8000
#: weights of the pooled covariance, and of its mean variance on the diagonal
TO_POOLED, TO_ROUND = 0.1, 0.02
#: statistics count no further than this from the mean, in standard deviations
FAR = 3.0
LOWER, UPPER, DIGIT, SPACE, SIGN = range(5)


@cache
def _kinds() -> np.ndarray:
    """Character kind by code point, for the basic plane; beyond it all count as signs."""

    def kind(c: str) -> int:
        k = unicodedata.category(c)
        return SPACE if c.isspace() else UPPER if k == "Lu" else LOWER if k[0] == "L" else DIGIT if k[0] == "N" else SIGN

    return np.array([kind(chr(c)) for c in range(1 << 16)], dtype=np.uint8)


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a text."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = max(1, len(points))
    kinds = np.bincount(_kinds()[np.minimum(points, 0xFFFF)], minlength=5)
    letters = max(1, kinds[LOWER] + kinds[UPPER])
    words = text.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(lines))
    bare = sum(c for w, c in seen.items() if not w[0].isalnum() and not w[-1].isalnum())
    ends = sum(c for w, c in seen.items() if w[-1] in ".!?")
    tailed = sum(c for w, c in seen.items() if len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum())

    def share(a: float, b: float) -> float:  # log odds, away from 0 and 1
        a = (a + 0.5) / (b + 1)
        return float(np.log(a / max(1e-9, 1 - a))) if a < 1 else 8.0

    return np.array([
        share(kinds[UPPER], letters), share(kinds[DIGIT], n), share(kinds[SIGN], n), share(kinds[SPACE], n),
        np.log1p(sizes.mean()), np.log1p(sizes.std()), np.log1p(sizes.max()),
        share(bare, m), share(ends, m), share(tailed, m),
        share(len(seen), m), share(max(seen.values(), default=0), m),
        np.log1p(len(text) / k), np.log1p(len(words) / k), share(len(set(lines)), k),
    ])


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the covariance, log density's constant; the scale
    of the statistics."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of the second class for each row of statistics."""
        if not self.classes:
            return np.full(len(x), self.share)
        x = np.clip((x - self.centre) / self.scale, -FAR, FAR)
        log = [c - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, c in self.classes]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))


def discriminant(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Fit to rows of statistics and their labels 0 and 1."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return Discriminant(np.zeros(1), np.ones(1), (), share)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - centre) / scale, -FAR, FAR)
    groups = [x[y == k] for k in (0, 1)]
    spread = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * s for g, s in zip(groups, spread, strict=True)) / len(x)
    round_ = np.eye(x.shape[1]) * np.trace(pooled) / x.shape[1]
    classes = []
    for g, s in zip(groups, spread, strict=True):
        cov = (1 - TO_POOLED - TO_ROUND) * s + TO_POOLED * pooled + TO_ROUND * round_
        factor = np.linalg.cholesky(cov)
        constant = np.log(len(g) / len(x)) - np.log(np.diag(factor)).sum()
        classes.append((g.mean(axis=0), np.linalg.inv(factor), float(constant)))
    return Discriminant(centre, scale, tuple(classes), share)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Discriminant:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label: 1 for good texts, else 0)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": [statistics(t) for t in b["text"]]})

    rows = labelled(docs, labels, sample_rows) \
        .mapInPandas(measure, "doc_id long, label int, x array<double>").orderBy("doc_id", "x").collect()
    x = np.array([r["x"] for r in rows], dtype=float)
    return discriminant(x, np.array([r["label"] == 1 for r in rows], dtype=float))


def predict(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``docs`` with ``quality``, between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("quality double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [statistics(t) for t in batch]
            yield pd.DataFrame({"quality": shared.value.scores(np.array(rows)) if rows else []}, dtype=float)

    return with_struct(docs, score("text"), ("quality",))
