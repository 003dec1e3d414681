"""Nearest neighbours against exact search; vectors that take no part."""

import numpy as np
from pyspark.sql import functions as F

from shoplens.llm import ann


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_ranks_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 700)
    monkeypatch.setattr(ann, "QUERY_ROWS", 30)
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((20, 32))[rng.integers(0, 20, 2000)] + 0.7 * rng.standard_normal((2000, 32))) \
        * rng.uniform(0.2, 2, (2000, 1))
    x = x.astype(np.float32)
    found = ann.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0, 20).collect()
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, 2000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        rows = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert np.allclose([r.score for r in rows], score[[r.vec_id for r in rows]])
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len(set(np.argsort(-score)[:20]) & {r.vec_id for r in rows})
    assert hits >= 0.9 * 2000


def test_recall_with_ids_by_cluster_and_copies_first():
    rng = np.random.default_rng(4)
    copies = np.repeat(rng.standard_normal((4, 32)), 70, axis=0) + 1e-4 * rng.standard_normal((280, 32))
    rest = np.repeat(rng.standard_normal((20, 32)), 186, axis=0) + 0.7 * rng.standard_normal((3720, 32))
    x = np.vstack([copies, rest])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    coder = ann.fitted(x, 1.0, len(x), 20)
    index, hits = ann.Index(coder, np.arange(len(x)), x), []
    for q in range(280, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        found, _ = index.nearest(q, x[q], coder.query_codes(x[q:q + 1])[0], 20)
        hits.append(len(set(np.argsort(-score)[:20].tolist()) & set(found.tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 20))
    index = ann.Index(ann.learn(x, float(np.linalg.norm(x, axis=1).max())), np.arange(500), x)
    codes = index.coder.codes(x)
    for q in range(0, 500, 50):
        apart = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        for radius in (0, 3, 8, 13, 24, 40, 64):
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_few_rows_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (20, [2.0, 0.0]), (None, [1.0, 1.0]),
            (1, [0.5, 0.5]), (40, [0.0, 0.0])]
    got = ann.search(frame(spark, rows).selectExpr("*", "1 AS rank", "0 AS label"), F.col("vec_id") % 20 == 0, 3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0)]
    assert ann.search(frame(spark, []), F.col("vec_id") % 20 == 0, 3).collect() == []
    assert ann.search(frame(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0, 3).collect() == []
