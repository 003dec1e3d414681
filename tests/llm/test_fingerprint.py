"""Multiset fingerprints: order, insertion, deletion, likeness, and the order of neighbours."""

import pytest
from pyspark.sql import functions as F

from shoplens.llm import fingerprint as fp


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r.f for r in fp.fingerprint(df, "text", "f").orderBy("k").collect()]


def test_order_does_not_matter_but_counts_do(spark):
    a, b, c, d = prints(spark, ["x\ny\nz", "z\nx\ny", "x\ny\nz\nz", ""])
    assert a == b != c
    assert set(d.dense) | set(d.shards) == {0}


def test_insertion_and_deletion(spark):
    whole, rest, line = prints(spark, ["\n".join(f"line {k}" for k in range(300)),
                                       "\n".join(f"line {k}" for k in range(300) if k != 7), "line 7"])
    df = spark.createDataFrame([(whole, rest, line)], "w {0}, r {0}, l {0}".format(
        "struct<dense: array<bigint>, shards: array<bigint>>"))
    r = df.select(fp.combined(F.col("r"), F.col("l")).alias("added"),
                  fp.combined(F.col("w"), F.col("l"), -1).alias("removed"),
                  fp.likeness(F.col("w"), F.col("r")).alias("near"),
                  fp.likeness(F.col("w"), F.col("w")).alias("same")).first()
    assert r.added == whole and r.removed == rest
    assert r.near == pytest.approx(63 / 64) and r.same == 1.0


@pytest.mark.parametrize("ids", [[3, 1, 2], [10 ** 17, -5, 0, 7, 10 ** 12, -10 ** 18], [None, 4, 4, None, 2],
                                 list(range(3000, 0, -1)), [9], [5, 5]])
def test_next_documents(spark, ids, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 4)
    monkeypatch.setattr(fp, "GROUP", 16)
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    after = {order[k][1]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    assert {r.text: r.next_text for r in fp.with_next(docs).collect()} == after


@pytest.mark.parametrize("ids", [[2 ** 62, *range(2000)], [*range(1400), *[None] * 700], [7] * 1500,
                                 [-(2 ** 63), 2 ** 63 - 1, *range(50)]])
def test_buckets_stay_small(spark, ids, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 16)
    rows = [(i, f"one and the same beginning {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = docs.groupBy(fp._bucket(fp._borders(docs))).count().agg(F.max("count")).first()[0]
    assert sizes <= 8 * 16
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    after = {order[k][1]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    assert {r.text: r.next_text for r in fp.with_next(docs).collect()} == after


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "aé"), (4, "a\n" * 2000)], "doc_id long, text string") \
        .selectExpr("*", "'x' AS key", "0 AS n_chars")
    rows = {r.doc_id: r for r in fp.edited(docs).collect()}
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].near_next == 1.0
    assert rows[3].n_chars == 2 and len(rows[3].fingerprint) == 4 * 15 + 64 * 8
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows.values())
    assert fp.edited(docs.limit(0)).collect() == []
