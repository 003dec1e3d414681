"""The pipeline's stages on a small table, each against a plain version on its own input."""

import random

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from shoplens.llm import pii
from shoplens.llm.bpe import read_ranks
from test_minhash import brute
from test_mixing import targets

EN = "the cat and the dog of the house went to the garden with a ball and came back for the food"
FR = "le chat et le chien de la maison vont dans le jardin avec une balle et les enfants sont la"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"{(EN, FR)[k % 2]} {k} {'x' * (k % 7)} alpha{k} beta{k} gamma{k}", ("en", "fr")[k % 2], f"s{k % 3}")
            for k in range(60)]
    rows += [(100 + k, f"{EN} near copy of one and the same text with many words in a row {'!' * (k % 2)}", "en", "s0")
             for k in range(20)]
    rows += [(200, None, "en", "s1"), (201, "", None, None), (202, "12 34 !", "en", "s1"),
             (203, f"{EN} write to joe@mail.example.com now please", "en", None), (3, rows[3][1], "fr", "s0"),
             (None, f"{FR} sans nom", "fr", "s2")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    at = dict(P.STAGES)
    assert list(at) == ["language", "near_duplicates", "personal_data", "mixture", "tokens"]
    kept = at["language"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    rows = {r.doc_id for r in kept.collect()}
    assert rows == {r.doc_id for r in docs.collect()} - {200, 201, 202}

    single = at["near_duplicates"](spark, kept, "").cache()
    assert single.columns == docs.columns
    want = brute([(r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None])
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(
        i for i, (_, _, stays) in want.items() if stays)
    assert [r.text for r in single.where("doc_id IS NULL").collect()] == [f"{FR} sans nom"]

    clean = at["personal_data"](spark, single, "").cache()
    before = {r.doc_id: r.text for r in single.collect()}
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert r.text == pii.redacted(before[r.doc_id]) and r.n_chars == len(r.text)
    assert "<EMAIL>" in clean.where("doc_id = 203").first().text

    mixed = at["mixture"](spark, clean, "").cache()
    assert mixed.columns == docs.columns
    own, taken = {}, {}
    for r in clean.collect():
        own[r.source] = own.get(r.source, 0) + len(r.text.split())
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for s, t in targets(own).items():
        assert abs(taken.get(s, 0) - t) <= max(25, 0.1 * t)

    out = at["tokens"](spark, mixed, "").collect()
    with open(P.RANKS, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.bpe.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(out) == mixed.count()
    assert all(r.n_tokens == len(library.encode_ordinary(texts[r.doc_id])) for r in out)


def test_language_rejects_what_was_never_learned(spark, docs):
    foreign = ["кошка и собака пошли в сад и вернулись за едой " * 40, "η γάτα και ο σκύλος πήγαν στον κήπο " * 40,
               "猫和狗去了花园，然后回来吃东西。" * 40, f"{'кошка и собака пошли в сад ' * 40} the cat"]
    more = [(300 + k, t, None, "s0", len(t)) for k, t in enumerate(foreign)]
    kept = P.language(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), "")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {200, 201, 202}


def test_language_without_spaces_stays(spark):
    rng = random.Random(3)
    signs = "".join(chr(0x4E00 + 7 * k) for k in range(60))
    rows = [(k, "，".join("".join(rng.choice(signs) for _ in range(12)) for _ in range(8)), "zh") for k in range(60)]
    rows += [(100 + k, f"{EN} {k}", "en") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert P.language(spark, docs, "").count() == len(rows)


def test_near_duplicates_at_080(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(104)]
        rows.append((2 * k, " ".join(base)))
        cut = 5 + k % 8  # 95 to 88 of 100 shingles in common: Jaccard 0.90 to 0.79
        rows.append((2 * k + 1, " ".join(base[:104 - cut] + [f"v{rng.randrange(10 ** 6)}" for _ in range(cut)])))
    sets = {i: {tuple(t.split()[j:j + 5]) for j in range(100)} for i, t in rows}
    near = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 120, 2)}
    assert any(0.8 <= x < 0.85 for x in near.values()) and any(x < 0.8 for x in near.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or near[i - 1] < 0.8}


def test_empty_table(spark, docs):
    left = docs.limit(0)
    for _, stage in P.STAGES:
        left = stage(spark, left, "")
    assert left.collect() == []


def test_run(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and {"doc_id", "n_tokens", "ids_sha256"} <= set(got.columns)


def test_columns_of_any_name_pass(spark, docs):
    """Names that the stages and operators use for their own columns."""
    names = ["id", "words", "from", "copies", "gone", "again", "lang_pred", "lang_score", "lang_known", "words_here", "size", "kept",
             "spans", "words.here", "draw", "__copy", "n_tokens"]
    wide = docs.select("*", *(F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names))
    at = wide
    for name, stage in P.STAGES[:-1]:
        narrow = sorted(map(tuple, stage(spark, at.select(*docs.columns), "").collect()), key=str)
        at = stage(spark, at, "").cache()
        assert at.columns == wide.columns, name
        assert sorted(map(tuple, at.select(*docs.columns).collect()), key=str) == narrow
        for r in at.collect():
            assert all(r[n] == f"{n} {'-' if r.doc_id is None else r.doc_id}" for n in names), name
    last = P.tokens(spark, at, "")
    assert "text" not in last.columns and "gone" in last.columns and last.columns.count("n_tokens") == 1
    assert dict(last.dtypes)["n_tokens"] == "bigint" and last.count() == at.count()
