"""Byte-level BPE: equal to the tiktoken library, exact round trips, defined edge cases."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from shoplens.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    alphabet = list("abst 're'll''sdvm  \n\t\r.,!?12٣é漢字🙂 　 ́½²'")
    fixed = ["", "'", "'s", " 's", "a's", "''s", "'s's", "a  b", " \n", "\n\n a", "  ", "x \n y", "don't we'll I've",
             "a" * 300, "ab" * 500, "'re" * 100, "!" * 200 + "'s", "é" * 70, " " * 3000 + "x"]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def test_pattern_is_the_tokenizers():
    assert bpe.PATTERN == P.PATTERN


def test_equals_the_library(ranks, library):
    codec, some = bpe.Codec(ranks), texts()
    for text, ids in zip(some, codec.encode(some), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_every_class_of_code_points(ranks, library):
    points = [c for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    some = [f"a{chr(c)}1{chr(c)}!{chr(c)}." for c in points]
    codec = bpe.Codec(ranks)
    for text, ids in zip(some, codec.encode(some), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)


def test_memo_starts_anew(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_SLICES", 64)
    codec, some = bpe.Codec(ranks), texts()[19:400]
    for k in range(0, len(some), 5):
        for text, ids in zip(some[k:k + 5], codec.encode(some[k:k + 5]), strict=True):
            assert ids.tolist() == library.encode_ordinary(text)


def test_text_with_more_slices_than_the_memo_holds(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_SLICES", 64)
    codec = bpe.Codec(ranks)
    long = " ".join(f"{k}x{'é' * (k % 30)}{k * 7919}" for k in range(1000))
    for _ in range(2):
        some = ["", "short 1", long, "", long[::-1], "x"]
        for text, ids in zip(some, codec.encode(some), strict=True):
            assert ids.tolist() == library.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()
    assert len(codec.memo.slots) == 4 * 64


def test_frames(spark, library):
    rows = [(1, "it's 12 o'clock é"), (2, None), (3, ""), (1, "it's 12 o'clock é"), (4, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' AS n_tokens", "0 AS ids")
    for r in bpe.digests(docs, RANKS).collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    encoded = bpe.encode(docs, RANKS, offsets=True)
    for r in bpe.decode(encoded, RANKS).collect():
        raw = (r.text or "").encode()
        assert bytes(r.decoded) == raw and r.ids == library.encode_ordinary(r.text or "")
        ends = [*r.offsets[1:], len(raw)] if r.ids else []
        assert [raw[a:b] for a, b in zip(r.offsets, ends, strict=True)] == \
            [library.decode_single_token_bytes(i) for i in r.ids]
    assert bpe.digests(docs.limit(0), RANKS).collect() == []
