"""Language identification by word-first backoff.

A text's words are scored by the log frequency they have in each learned language. A word
that no language has seen falls back to character n-grams of the padded word, the longest
length first: the word takes the mean log frequency of its known n-grams of the first
length that knows any. The text's scores are summed over its words.

``lang_known`` tells whether a text is of a learned language at all, and doesn't grow with its
length: the share of its letters in words that the predicted language has, by the share that
the language's own texts have of words met elsewhere (Good and Turing: all but those met once).
Where words seldom recur, as without spaces, n-grams stand for them.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text if there is nothing to learn from. Ties go to the smaller language code. Repeated rows
are scored alike; other columns pass through, columns named as a result are replaced.

Fitting reads a bounded hash sample of the labelled texts (``sample_docs``) and keeps each language's
``max_words`` most frequent words; both bound the model that is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import bounded_sample, with_struct

UNKNOWN = "und"
SAMPLE_DOCS = 4000
MAX_WORDS = 15_000
NGRAMS = (4, 3, 2, 1)
#: a language is judged by the longest units of which its texts are covered to this share
COVERED = 0.6
#: letters of a text that words never seen can count by their n-grams of this length: a short
#: text may have no other
SHORT, CREDIT = 60, 3
SMOOTHING = 0.5
CACHE_WORDS = 50_000
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORDS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of the padded word; single letters come without the padding marks, which every word has."""
    padded = word if n == 1 else f"<{word}>"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


class Frequencies:
    """Log frequencies of strings per language: one table row for each string."""

    def __init__(self, counts: dict[str, int], cells: list[tuple[int, int, int]], langs: int):
        """counts: row of each string; cells: (row, language, occurrences)."""
        self.row = counts
        table = np.zeros((len(counts), langs))
        if cells:
            rows, lang, n = np.array(cells).T
            np.add.at(table, (rows, lang), n)
        self.seen = table > 0
        total = table.sum(axis=0) + SMOOTHING * max(1, len(counts))
        self.table = (np.log(table + SMOOTHING) - np.log(total)).astype(np.float32)


class BackoffModel:
    """Log frequencies per language of words, and of n-grams by length (plain tables, picklable)."""

    def __init__(self, counts: list[tuple[str, str, int]], letters_of: dict[str, int] | None = None):
        """counts: (language, word, occurrences); letters_of: all letters of each language's texts, where
        ``counts`` lacks some of their words."""
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}

        def frequencies(found: list[tuple[str, int, int]]) -> Frequencies:
            row: dict[str, int] = {}
            return Frequencies(row, [(row.setdefault(x, len(row)), k, n) for x, k, n in found], len(self.langs))

        self.words = frequencies([(w, at[lang], n) for lang, w, n in counts])
        self.grams = {size: frequencies([(g, at[lang], n) for lang, w, n in counts for g in grams_of(w, size)])
                      for size in NGRAMS}

        # per language: units by which it is judged (0: words), and the share of its letters that they cover
        self.unit, self.cover = np.zeros(len(self.langs), dtype=int), np.ones(len(self.langs))
        for k, lang in enumerate(self.langs):
            own = [(w, n) for x, w, n in counts if x == lang]
            letters = sum(n * len(w) for w, n in own)
            again = letters - sum(len(w) for w, n in own if n == 1)
            shares = [(0, again / max(1, letters, (letters_of or {}).get(lang, 0)))]
            for size in NGRAMS:
                met = Counter()
                for w, n in own:
                    for g in grams_of(w, size):
                        met[g] += n
                shares.append((size, 1 - sum(n == 1 for n in met.values()) / max(1, met.total())))
            self.unit[k], self.cover[k] = next((x for x in shares if x[1] >= COVERED), max(shares, key=lambda x: x[1]))
        self.by_words, self.sizes = self.unit == 0, sorted(set(self.unit.tolist()) - {0})
        self.whole = np.maximum(self.cover, 1e-9)

    def _hits(self, words: list[str], size: int) -> tuple[list[int], list[int], list[int], list[int]]:
        """Of the words' n-grams those that were learned, word after word: their rows; the words that have any, where
        each one's rows begin, and how many n-grams each word has."""
        get, rows, which, first, lengths = self.grams[size].row.get, [], [], [], []
        for k, w in enumerate(words):
            grams = grams_of(w, size)
            found = [r for r in map(get, grams) if r is not None]
            lengths.append(len(grams))
            if found:
                which.append(k)
                first.append(len(rows))
                rows += found
        return rows, which, first, lengths

    def known_words(self, words: list[str]) -> np.ndarray:
        """(word, 2, language): for each language the share of the word that it knows, by its share of known letters;
        beside it the same by n-grams for words that it hasn't seen."""
        out = np.zeros((len(words), 2, len(self.langs)))
        met = [(k, r) for k, w in enumerate(words) if (r := self.words.row.get(w)) is not None]
        if met:
            at, rows = map(list, zip(*met))
            out[at, 0] = self.words.seen[rows] & self.by_words
        for size in self.sizes:
            np.copyto(out[:, 0], self._known_grams(words, size), where=self.unit == size)
        unseen = self.by_words & (out[:, 0] == 0)
        some = np.flatnonzero(unseen.any(axis=1))
        if len(some):
            out[some, 1] = self._known_grams([words[k] for k in some], CREDIT) * unseen[some]
        return out / self.whole

    def _known_grams(self, words: list[str], size: int) -> np.ndarray:
        """The share of each word's n-grams that each language has."""
        out = np.zeros((len(words), len(self.langs)))
        rows, which, first, lengths = self._hits(words, size)
        if rows:
            out[which] = np.add.reduceat(self.grams[size].seen[rows].astype(np.float64), first, axis=0)
        return out / np.maximum(1, lengths)[:, None]

    def score_words(self, words: list[str]) -> np.ndarray:
        """(word, language): log frequencies."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        left = []
        met: tuple[list[int], list[int]] = [], []
        for k, w in enumerate(words):
            row = self.words.row.get(w)
            if row is None:
                left.append(k)
            else:
                met[0].append(k)
                met[1].append(row)
        if met[0]:
            out[met[0]] = self.words.table[met[1]]
        for size in NGRAMS:
            if not left:
                break
            rows, which, first, _ = self._hits([words[k] for k in left], size)
            if rows:
                number = np.diff([*first, len(rows)])[:, None]
                out[[left[j] for j in which]] = np.add.reduceat(self.grams[size].table[rows], first, axis=0) / number
                done = set(which)
                left = [k for j, k in enumerate(left) if j not in done]
        return out


class Scorer:
    """Scores texts against a model; remembers what it knows of recent words, CACHE_WORDS at most
    before a text's own."""

    def __init__(self, model: BackoffModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        langs = len(self.model.langs)
        self.table, self.share = np.empty((4096, langs), dtype=np.float32), np.empty((4096, 2, langs), dtype=np.float32)
        #: words whose share is filled in
        self.shared = 0

    def _rows(self, words: list[str]) -> list[int]:
        """The words' rows, known or new."""
        rows = list(map(self.index.get, words))
        if None not in rows:
            return rows
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        k = len(self.index)
        while k + len(new) > len(self.table):
            self.table, self.share = (np.concatenate([x, np.empty_like(x)]) for x in (self.table, self.share))
        self.table[k:k + len(new)] = self.model.score_words(new)
        self.index.update(zip(new, range(k, k + len(new))))
        return list(map(self.index.get, words))

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if len(self.index) > CACHE_WORDS:
            self._clear()
        rows = self._rows(words)
        total = self.table[rows].sum(axis=0, dtype=np.float64)
        total -= total.max()
        p = np.exp(total)
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum())

    def known(self, text: str | None, lang: str) -> float:
        """How much of a text is known to ``lang``, by what of its own texts is: about 1 for these."""
        found = Counter(words_of(text)) if text and lang in self.model.langs else None
        if not found:
            return 0.0
        rows = self._rows(list(found))
        if self.shared < len(self.index):
            new = list(islice(reversed(self.index), len(self.index) - self.shared))[::-1]
            self.share[self.shared:len(self.index)] = self.model.known_words(new)
            self.shared = len(self.index)
        letters = np.array([n * len(w) for w, n in found.items()])
        seen, alike = letters @ self.share[rows, :, self.model.langs.index(lang)].astype(np.float64)
        return float((seen + min(alike, SHORT)) / letters.sum())


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS) -> BackoffModel:
    """Learn from rows of (doc_id, text, lang); rows with a null in any of the three teach nothing."""
    rows = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL")
    sample = bounded_sample(rows, F.col("doc_id"), sample_docs).where("text IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b["lang"], b["text"], strict=True):
                for w, n in Counter(words_of(text)).items():
                    found[lang, w] += n
            yield pd.DataFrame({"lang": [k[0] for k in found], "word": [k[1] for k in found],
                                "n": list(found.values())})

    every = (sample.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    counts = every.withColumn("rank", rank).where(F.col("rank") <= max_words).orderBy("lang", "rank").collect()
    letters = dict(map(tuple, every.groupBy("lang").agg(F.sum(F.col("n") * F.char_length("word"))).collect()))
    return BackoffModel([(r["lang"], r["word"], r["n"]) for r in counts], letters)


def predict(docs: DataFrame, model: BackoffModel, known: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (posterior of the predicted language) and, if asked
    for, ``lang_known``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("lang_pred", "lang_score", "lang_known") if known else ("lang_pred", "lang_score")

    @F.pandas_udf("lang_pred string, lang_score double" + ", lang_known double" * known)
    def identify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in texts:
            rows = [(*found, scorer.known(t, found[0])) if known else found for t in batch for found in (scorer(t),)]
            yield pd.DataFrame(rows, columns=list(names))

    return with_struct(docs, identify("text"), names)
