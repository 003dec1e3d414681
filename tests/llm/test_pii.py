"""PII: base spans equal the plain patterns, disguises map back to source characters."""

import random
import re

import pytest

from shoplens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_slow(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn_slow(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if keep:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_equals_the_patterns_on_random_texts():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "-", "+", " ", "1", "42", "255", "300", "0", "4111 1111 1111 1111", "(017) ",
             "é", "\n", "x@y.z", "+1 ", "555-77", "1.2.3.4", "%", "999999999999994"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text, kind, found", [
    ("write to joe.smith [at] mail1 [dot] example [dot] com now", "email",
     "joe.smith [at] mail1 [dot] example [dot] com"),
    ("or joe(at)mail.example.com!", "email", "joe(at)mail.example.com"),
    ("or joe at mail dot example dot com today", "email", "joe at mail dot example dot com"),
    ("fullwidth joe＠mail．example．com", "email", "joe＠mail．example．com"),
    ("jо@mail.com with a Cyrillic letter", "email", "jо@mail.com"),
    ("joe @ mail.example.com", "email", "joe @ mail.example.com"),
    ("call plus one three one five five five five zero one two three ok", "phone",
     "plus one three one five five five five zero one two three"),
    ("call +١ (٠١٧) ٥٥٥-٧٧١٣", "phone", "+١ (٠١٧) ٥٥٥-٧٧١٣"),
    ("card 4111​1111​1111​1111 hidden", "card", "4111​1111​1111​1111"),
    ("call +1 (O17) 555-77l3 x", "phone", "+1 (O17) 555-77l3"),
    ("host １９２.168.0.1", "ip", "１９２.168.0.1"),
])
def test_disguises(text, kind, found):
    base, more = pii.all_spans(text)
    assert (kind, text.index(found), text.index(found) + len(found)) in more
    assert base == brute(text)


@pytest.mark.parametrize("text", [
    "look at the dot on the map", "meet at noon. One two, three", "one or two at the dot com era? yes",
    "déjà vu à l'école (at least)", "", "At dot at dot", "he is at home. Dot. com", "ten at a time: 3 x 4l"])
def test_clean_texts_stay_alone(text):
    assert pii.all_spans(text) == ([], [])
    assert pii.redacted(text) == text


def test_long_texts_are_linear():
    for part in ("a", "1", "1.", "a@", "+1", "at ", "one ", " dot", "1 ", "٣", "@."):
        pii.all_spans(part * (200_000 // len(part)))


def test_redacted_merges_overlaps():
    assert pii.redacted("mail joe@mail.example.com or +1 (017) 555-7713.") == "mail <EMAIL> or <PHONE>."


def test_frames(spark):
    rows = [(1, "a@b.cc", 6), (2, None, None), (3, "", 0), (1, "a@b.cc", 6), (4, "x joe(at)b.com", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long") \
        .selectExpr("*", "'old' AS spans", "1 AS kind")
    got = {(r.doc_id, tuple((s.kind, s.start, s.end, s.base) for s in r.spans)) for r in pii.detect(docs).collect()}
    assert got == {(1, (("email", 0, 6, True),)), (2, ()), (3, ()), (4, (("email", 2, 14, False),))}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in clean.where("doc_id <> 2").collect()) == [
        (1, "<EMAIL>", 7), (1, "<EMAIL>", 7), (3, "", 0), (4, "x <EMAIL>", 9)]
    assert clean.where("doc_id = 2").first().text is None
    assert pii.detect(docs.limit(0)).collect() == []
