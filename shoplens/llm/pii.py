"""Personal data: e-mail and IP addresses, card and phone numbers, also behind disguises.

Base spans are the leftmost non-overlapping matches of each kind's pattern; a match that fails
its kind's test (IP parts, Luhn sum, number of digits) is dropped and not tried again.

Further spans come from a deobfuscated copy of the text. Transducers rewrite it step by step
and carry along, for each character, the source range it stands for: look-alike letters,
digits of other scripts and invisible characters; spelled digits; digits written as letters;
bracketed or worded "at" and "dot", and spaces around "@". The base patterns run on the copy
and their spans map back to source characters. A mapped span is added unless a base span of its
kind covers it; base spans always stay.

A clean text must stay alone, so the worded forms are narrow: "at" needs a disguised dot and a
common top-level domain behind it, digits are read from runs of three or more spelled digits.

Defined results: null and empty texts have no spans. All work on a text is linear in its
length. Repeated rows give equal spans; other columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import with_struct

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits is tried from its start only: from within, the rest would be the same
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_IP_HINT = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")

#: look-alikes of Latin letters (fixed values); other forms follow from Unicode's compatibility mapping
LOOKALIKES = dict(zip(
    "аеорсхуіјѕԁһкмтвнАВЕКМНОРСТХУІЈЅοαεικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcxyijsdhkmtbhABEKMHOPCTXYIJSoaeikvptuxABEZHIKMNOPTYX", strict=True))
#: full stops and at signs that the compatibility mapping leaves alone (fixed values)
MARKS = {"。": ".", "｡": ".", "․": ".", "‐": "-", "‑": "-", "−": "-"}
#: spelled digits of the corpus's four languages (fixed values)
SPELLED = {word: str(d) for d, words in enumerate((
    "zero oh zéro null cero", "one un eins uno", "two deux zwei dos", "three trois drei tres",
    "four quatre vier cuatro", "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete",
    "eight huit acht ocho", "nine neuf neun nueve")) for word in words.split()}
#: top-level domains that a worded "at ... dot" must end in (fixed values)
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "me", "dev", "app", "de", "fr", "es",
           "it", "nl", "ch", "at", "be", "uk", "eu", "us", "ca", "au", "ru", "br", "mx", "example", "test")

#: words before "dot" that make a phrase, not a host
ARTICLES = ("a.", "an.", "the.", "this.", "that.", "every.", "each.")

_ODD = re.compile("[^\x00-\x7e\xa1-\xac\xae-˿]")
_DIGIT_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_DIGIT_RUN = re.compile(rf"(?<!\w)(?:{_DIGIT_WORD}|[0-9]+)(?:(?:[ ,-]|, )(?:{_DIGIT_WORD}|[0-9]+))+(?!\w)", re.I)
_DIGIT_TOKEN = re.compile(r"[^\W_]+")
_DIGIT_HINT = re.compile(rf"(?<!\w){_DIGIT_WORD}[ ,-]{{1,2}}{_DIGIT_WORD}(?!\w)", re.I)
_PLUS = re.compile(r"(?<!\w)plus[ ](?=[0-9])", re.I)
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])(?=[OolI]*[0-9])[0-9OolI]{2,}(?![A-Za-z0-9])")
_LETTER_HINT = re.compile(r"[0-9](?:[OolI]|(?<=[OolI].))")
_BRACKET_AT = re.compile(r" {0,3}[\[({<] {0,2}(?:at|@) {0,2}[\])}>] {0,3}", re.I)
_BRACKET_DOT = re.compile(r" {0,3}[\[({<] {0,2}(?:dot|\.) {0,2}[\])}>] {0,3}", re.I)
_WORD_DOT = re.compile(r"(?<=[A-Za-z0-9]) {1,3}dot {1,3}(?=[A-Za-z0-9])", re.I)
_WORD_AT = re.compile(r"(?<=[A-Za-z0-9._%+-]) {1,3}at {1,3}(?=((?:[A-Za-z0-9-]++\.)+)([A-Za-z]+))", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])(?: {1,3}@ {0,3}| {0,3}@ {1,3})(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])")
_BRACKET_HINT = re.compile(r"[\[({<] {0,2}(?:at|@|dot|\.) {0,2}[\])}>]", re.I)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the plain patterns, by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _IP_HINT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@lru_cache(maxsize=4096)
def plain(c: str) -> str:
    """What a character looks like: an ASCII character, nothing for an invisible one, else itself."""
    if c in LOOKALIKES or c in MARKS:
        return LOOKALIKES.get(c) or MARKS[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind == "Zs":
        return " "
    if kind == "Pd":
        return "-"
    same = unicodedata.normalize("NFKC", c)
    return same if kind[0] in "LPS" and len(same) == 1 and same < "\x7f" else c


class Tape:
    """A rewritten text; character k stands for the source characters start[k] .. end[k] - 1."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.worded: set[int] = set()  # source positions of dots that were disguised

    def sub(self, pattern: re.Pattern, by: Callable[[re.Match], list[tuple[str, int, int]] | None]) -> None:
        """Replace matches by characters, each with the range of the present text it stands for."""
        text, start, end, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = by(m)
            if new is None:
                continue
            a, b = m.span()
            text.append(self.text[done:a])
            start += self.start[done:a]
            end += self.end[done:a]
            for c, i, j in new:
                text.append(c)
                start.append(self.start[i])
                end.append(self.end[j - 1])
            done = b
        if done:
            text.append(self.text[done:])
            self.start = start + self.start[done:]
            self.end = end + self.end[done:]
            self.text = "".join(text)

    def dot(self, m: re.Match) -> list[tuple[str, int, int]]:
        self.worded.add(self.start[m.start()])
        return [(".", *m.span())]


def _odd(m: re.Match) -> list[tuple[str, int, int]]:
    return [(c, *m.span()) for c in plain(m[0])]


def _digits(m: re.Match) -> list[tuple[str, int, int]] | None:
    found = [(t, SPELLED.get(t[0].lower())) for t in _DIGIT_TOKEN.finditer(m[0])]
    if sum(d is not None for _, d in found) < 3:
        return None
    out, base = [], m.start()
    for t, d in found:
        a, b = base + t.start(), base + t.end()
        out += [(d, a, b)] if d is not None else [(c, a + k, a + k + 1) for k, c in enumerate(t[0])]
    return out


def _letter_digits(m: re.Match) -> list[tuple[str, int, int]]:
    a = m.start()
    return [({"O": "0", "o": "0", "l": "1", "I": "1"}.get(c, c), a + k, a + k + 1) for k, c in enumerate(m[0])]


def _mail_hint(text: str, lower: str) -> bool:
    return " dot " in lower or " @" in text or "@ " in text or bool(_BRACKET_HINT.search(text))


def _digit_hint(text: str, lower: str) -> bool:
    words = lower.replace("-", " ").replace(",", " ").split()
    return not SPELLED.keys().isdisjoint(words) and bool(_DIGIT_HINT.search(text))


def deobfuscate(text: str) -> Tape | None:
    """The rewritten text, None if there is nothing to rewrite."""
    odd, lower = not text.isascii() and bool(_ODD.search(text)), text.lower()
    if not (odd or _mail_hint(text, lower) or _digit_hint(text, lower) or _LETTER_HINT.search(text)):
        return None
    tape = Tape(text)
    if odd:
        tape.sub(_ODD, _odd)
    if _digit_hint(tape.text, tape.text.lower()):
        tape.sub(_DIGIT_RUN, _digits)
        tape.sub(_PLUS, lambda m: [("+", *m.span())])
    if _LETTER_HINT.search(tape.text):
        tape.sub(_LETTER_DIGITS, _letter_digits)
    if _mail_hint(tape.text, tape.text.lower()):
        tape.sub(_BRACKET_AT, lambda m: [("@", *m.span())])
        tape.sub(_BRACKET_DOT, tape.dot)
        tape.sub(_WORD_DOT, tape.dot)

        def worded_at(m: re.Match) -> list[tuple[str, int, int]] | None:
            dots = {tape.start[k] for k in range(m.start(1), m.end(1)) if tape.text[k] == "."}
            worded = dots & tape.worded and m[2].lower() in DOMAINS and m[1].lower() not in ARTICLES
            return [("@", *m.span())] if worded else None

        if tape.worded:
            tape.sub(_WORD_AT, worded_at)
        tape.sub(_SPACED_AT, lambda m: [("@", *m.span())])
    return tape


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that only the deobfuscated text shows."""
    base = base_spans(text)
    tape = deobfuscate(text)
    if tape is None or tape.text == text:
        return base, []
    known = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    more = []
    for kind, a, b in base_spans(tape.text):
        span = tape.start[a], tape.end[b - 1]
        if not _covered(known[kind], *span):
            more.append((kind, *span))
    return base, ordered(more)


def _covered(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the spans, which are in order and don't overlap, covers a .. b."""
    lo, hi = 0, len(spans)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if spans[mid][0] <= a else (lo, mid)
    return lo > 0 and spans[lo - 1][1] >= b


def redacted(text: str) -> str:
    """The text with each span, or chain of overlapping spans, replaced by its first kind's name."""
    out, done = [], 0
    base, more = all_spans(text)
    if not base and not more:
        return text
    for kind, a, b in ordered(base + more):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, base), by start, then kind; code points,
    end exclusive."""

    @F.pandas_udf("array<struct<kind: string, start: int, end: int, base: boolean>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            rows = []
            for text in batch:
                base, more = all_spans(text) if text else ([], [])
                plainly = set(base)
                rows.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in plainly}
                             for k, a, b in ordered(base + more)])
            yield pd.Series(rows, dtype=object)

    return with_struct(docs, F.struct(run("text").alias("spans")), ("spans",))


def listing(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by their kinds' names; null texts stay null, and
    ``n_chars``, if there, counts the new text."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([redacted(t) if t else t for t in batch], dtype=object)

    out = docs.withColumn("text", run("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.lit(0).cast(kind)))
    return out.select(*docs.columns)
