"""Language, toxicity and quality: held-out accuracy, defined scores of odd texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shoplens.llm import lang_id, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 !?"), (5, "a" * 300_000), (6, "x\x00y"), (1, "the"), (None, "the and of")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr(
        "*", "1 AS lang_pred", "2 AS toxicity", "3 AS quality", "4 AS label", "5 AS n")


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in E.queries()["op6_lang_id"](spark, SF).collect() if r.held_out]
    assert len(rows) > 150
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.98


def test_words_before_ngrams():
    model = lang_id.BackoffModel([("en", "thing", 9), ("de", "ding", 9), ("de", "dong", 3)])
    assert model.langs == ["de", "en"]
    known, unseen = model.score_words(["thing", "dingsbums"])
    assert known[1] > known[0] and unseen[0] > unseen[1]
    assert (model.score_words(["漢字"])[0] == 0).sum() in (0, 2)


def test_odd_texts(spark):
    docs = odd(spark)
    model = lang_id.fit(spark.createDataFrame([(1, "the and of", "en"), (2, "der und", "de"), (3, None, "en"), (4, "x", None)],
                                              "doc_id long, text string, lang string"))
    got = lang_id.predict(docs, model).collect()
    assert len(got) == len(ODD)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert all(0 <= r.lang_score <= 1 for r in got)
    nothing = lang_id.fit(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"))
    assert {r.lang_pred for r in lang_id.predict(docs, nothing).collect()} == {"und"}
    assert lang_id.predict(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("name, label, least", [("op8_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.85)])
def test_held_out(spark, name, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in E.queries()[name](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    score = np.array([r.score for r in rows])
    truth = np.array([labels[r.doc_id] for r in rows])
    assert len(rows) > 500 and ((score >= 0) & (score <= 1)).all()
    above = (score[truth == 1][:, None] > score[truth == 0]).mean()
    assert above + (score[truth == 1][:, None] == score[truth == 0]).mean() / 2 > least


def test_nnpu_finds_the_marked_words(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]

    def text(bad):
        w = rng.choices(words, k=30)
        if bad:
            w[3] = "zorkel" + rng.choice(["en", "st", "ig"])
        return " ".join(w)

    docs = spark.createDataFrame([(k, text(k % 8 == 0)) for k in range(1200)], "doc_id long, text string")
    labels = docs.where("doc_id < 800").selectExpr("doc_id", "CAST(doc_id % 8 = 0 AS int) AS label")
    model = toxicity.fit(docs, labels.union(labels).unionByName(spark.createDataFrame([(None, 1), (5, None)], labels.schema)))
    got = {r.doc_id: r.toxicity for r in toxicity.predict(docs.where("doc_id >= 800"), model).collect()}
    assert all((s >= 0.3) == (k % 8 == 0) for k, s in got.items())
    assert all(0 <= r.toxicity <= 1 for r in toxicity.predict(odd(spark), model).collect())
    none = toxicity.fit(docs, labels.where("label > 1"))
    assert max(r.toxicity for r in toxicity.predict(docs.limit(3), none).collect()) < 1e-20


def test_discriminant_against_densities():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0.0, 1.0], [400, 300])
    model = quality.discriminant(x, y)
    z = np.clip((x - model.centre) / model.scale, -quality.FAR, quality.FAR)
    log = []
    for mean, inverse, _ in model.classes:
        cov = np.linalg.inv(inverse.T @ inverse)
        d = z - mean
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + 400 / 300 * np.exp(log[0] - log[1]))
    assert np.allclose(model.scores(x), want)


def test_quality_of_odd_texts(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(3, 0), (4, 0), (5, 1), (6, 1)], "doc_id long, label int")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    got = quality.predict(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.quality <= 1 for r in got)
    assert {r.quality for r in quality.predict(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.predict(docs.limit(0), model).collect() == []
    assert docs.where(F.col("text").isNull()).count() == 1


def test_sample_is_bounded_whatever_the_keys(spark):
    from pyspark.sql import functions as F

    from shoplens.llm.common import bounded_sample
    rows = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("k"), F.lit("same").alias("text"))
    for df in (rows, rows.unionByName(same), same):
        n = bounded_sample(df, F.col("k"), 500).count()
        assert n <= 650 and bounded_sample(df, F.col("k"), 500).count() == n
    assert bounded_sample(rows, F.col("k"), 500).count() > 350
    assert bounded_sample(rows, F.col("k"), 20_000).count() == 20_000


def test_each_language_keeps_its_words(spark):
    rows = [(k, " ".join(f"common{''.join(chr(97 + int(c)) for c in str(j))}" for j in range(300)), "aa") for k in range(30)]
    rows += [(100 + k, "rara avis in terra", "bb") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs, max_words=50)
    assert model.langs == ["aa", "bb"] and sum(model.words.seen[:, 1]) == 4 and sum(model.words.seen[:, 0]) == 50
