"""Toxicity by non-negative positive-unlabelled learning.

Two samples teach: P, texts confirmed as toxic, and U, texts of the corpus whatever they are.
With the class prior p, the share of toxic texts in U, the risk of a scorer f is

    p * E_P[loss(f)] + max(0, E_U[loss(-f)] - p * E_P[loss(-f)]),

the second term being the risk on clean texts, which U holds together with the toxic ones. Where
that estimate falls below zero the step goes back up on it instead (the correction that keeps a
flexible model from overfitting P).

Features are the presence of words and of word beginnings; those that tell P from U with some
certainty are kept, the weightiest first. f is linear in them, trained in numpy; the score is its logistic value.

Defined results: null and empty texts have no features and get the score of that. Without
confirmed examples every score is 0. Repeated rows score alike; other columns pass through.
Fitting reads bounded hash samples (``positives``, ``unlabelled``); all texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import bounded_sample, with_struct
from shoplens.llm.features import labelled

POSITIVES, UNLABELLED = 2500, 6000
MAX_FEATURES = 512
BEGINNINGS = (4, 5, 6)
#: a feature must occur in so many texts of P, and make a text toxic with at least this probability
#: (the prior times its rate in P over that in U, counts taken a standard deviation to the worse)
SUPPORT, CERTAINTY = 5, 0.5
STEPS, RATE, DECAY = 800, 0.05, 1e-5
CACHE_WORDS = 200_000
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings."""
    return ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def nnpu(x_p: np.ndarray, x_u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer, by Adam on the non-negative PU risk with logistic loss."""

    def slope(f: np.ndarray) -> np.ndarray:  # of loss(f) = log(1 + exp(-f))
        return -1 / (1 + np.exp(np.clip(f, -60, 60)))

    w = np.zeros(x_p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    x_p, x_u = (np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]) for x in (x_p, x_u))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        f_p, f_u = x_p @ w, x_u @ w
        toxic = prior * (x_p.T @ slope(f_p)) / len(x_p)
        clean = -(x_u.T @ slope(-f_u)) / len(x_u) + prior * (x_p.T @ slope(-f_p)) / len(x_p)
        risk = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        grad = (toxic + clean if risk >= 0 else -clean) + DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Model:
    """Number of each feature, weights, bias."""

    features: dict[str, int]
    weights: np.ndarray
    bias: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, tuple[int, ...]] = {}

    def found(self, text: str | None) -> list[int]:
        """The numbers of the model's features in a text."""
        if len(self.memo) > CACHE_WORDS:
            self.memo.clear()
        out: set[int] = set()
        memo, known = self.memo, self.model.features
        for w in words_of(text):
            hits = memo.get(w)
            if hits is None:
                hits = memo[w] = tuple(known[x] for x in features_of(w) if x in known)
            if hits:
                out.update(hits)
        return sorted(out)

    def __call__(self, text: str | None) -> float:
        f = self.model.bias + self.model.weights[self.found(text)].sum()
        return float(1 / (1 + np.exp(-np.clip(f, -60, 60))))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label: 1 for confirmed toxic texts).

    The class prior is the share of toxic rows among the labelled ones; nothing else is taken
    from the rows labelled clean, which are unlabelled texts like all others.
    """
    rated = labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
    prior = rated.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    if not prior:
        return Model({}, np.zeros(0), -60.0)
    prior = min(prior, 0.99)
    sample = labelled(docs, rated.where("label = 1"), positives).select(F.lit(1).alias("p"), "text").union(
        bounded_sample(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), F.col("doc_id"), unlabelled)
        .where("text IS NOT NULL").select(F.lit(0), "text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for p, text in zip(b["p"], b["text"], strict=True):
                seen[p].update({x for w in words_of(text) for x in features_of(w)})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"feature": keys, "p": [seen[1][k] for k in keys], "u": [seen[0][k] for k in keys]})

    n = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    worse = (F.col("p") - F.sqrt("p")) / n[1], (F.col("u") + F.sqrt("u") + 1) / n[0]
    weight = F.round(F.col("p") * F.log(((F.col("p") + 0.5) / n[1]) / ((F.col("u") + 0.5) / n[0])), 6)
    best = (sample.mapInPandas(count, "feature string, p long, u long")
            .groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
            .where((F.col("p") >= SUPPORT) & (worse[0] * prior / worse[1] >= CERTAINTY))
            .orderBy(F.desc(weight), "feature").limit(MAX_FEATURES).select("feature").collect())
    model = Model({r["feature"]: k for k, r in enumerate(best)}, np.zeros(len(best)), 0.0)

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            yield pd.DataFrame({"p": b["p"], "found": [scorer.found(t) for t in b["text"]]})

    x = {0: [], 1: []}
    for r in sample.mapInPandas(present, "p int, found array<int>").orderBy("p", "found").collect():
        row = np.zeros(len(best), dtype=np.float32)
        row[r["found"]] = 1
        x[r["p"]].append(row)
    weights, bias = nnpu(np.stack(x[1]), np.stack(x[0]), prior)
    return Model(model.features, weights, bias)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity``, between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("toxicity double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in texts:
            yield pd.DataFrame({"toxicity": [scorer(t) for t in batch]}, dtype=float)

    return with_struct(docs, score("text"), ("toxicity",))
