"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors become 64-bit codes: principal directions of a sample, turned by the rotation that
brings their signs nearest to the data (iterative quantisation). A code is cut into eight
substrings, each with its own posting lists. A code within Hamming radius R = 8 r + a of a
query's agrees with it to r bits in one of the first a + 1 substrings or to r - 1 bits in one of
the others (pigeonhole), so probing the lists of those keys finds every code within R. What
is found is checked on whole codes and ranked by the vectors themselves, in double precision.

R is learned from the sample: the radius that holds COVER of the neighbours which exact search
finds there for queries drawn from all of it, repeated vectors once. A query that finds fewer
than k in a block goes on with larger radii.

Inner products: vectors get one more component that brings all to the same length, which
makes the largest inner product the smallest angle.

The index is built in blocks of about BLOCK_ROWS vectors; query blocks meet index blocks in a
grid, each cell one bounded group, and a query's best of all cells are merged.

Defined results: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part, nor do rows without vec_id. Rows with the query's vec_id are
its own. Ties go to the smaller vec_id; repeated candidates with the same vec_id count once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import bounded_sample

BITS, PARTS = 64, 8
SAMPLE_ROWS, SAMPLE_QUERIES, TURNS = 4096, 256, 40
COVER = 0.98
BLOCK_ROWS, QUERY_ROWS = 8192, 1024


@cache
def _probes() -> list[list[np.ndarray]]:
    """keys[r][q]: the 8-bit keys within r bits of q."""
    every = np.arange(256, dtype=np.uint8)
    apart = np.bitwise_count(every[:, None] ^ every)
    return [[np.flatnonzero(apart[q] <= r) for q in range(256)] for r in range(9)]


@dataclass(frozen=True)
class Coder:
    """Codes of vectors: signs of centred, projected and rotated vectors."""

    centre: np.ndarray
    turned: np.ndarray
    longest: float
    radius: int = 0

    def _lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, self.longest ** 2 - (x * x).sum(axis=1))
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.turned > 0, axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(n, 8) bytes for candidates."""
        return self._codes(self._lengthened(x))

    def query_codes(self, x: np.ndarray) -> np.ndarray:
        scale = self.longest / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return self._codes(np.hstack([x * scale, np.zeros((len(x), 1))]))


def learn(x: np.ndarray, longest: float) -> Coder:
    """Principal directions and iterative quantisation; with fewer directions than bits, several
    rotations of the same directions are learned."""
    rng = np.random.default_rng(3)
    blank = Coder(np.zeros(x.shape[1] + 1), np.zeros((x.shape[1] + 1, BITS)), longest)
    x = blank._lengthened(x)
    centre = x.mean(axis=0)
    _, basis = np.linalg.eigh((x - centre).T @ (x - centre))
    made, columns = [], 0
    while columns < BITS:
        directions = basis[:, ::-1][:, :min(BITS - columns, basis.shape[1])]
        v = (x - centre) @ directions
        rotation = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(TURNS):
            u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
            rotation = (u @ w).T
        made.append(directions @ rotation)
        columns += v.shape[1]
    return Coder(centre, np.hstack(made), longest)


def fitted(x: np.ndarray, longest: float, rows: int, k: int) -> Coder:
    """A coder with the radius that holds COVER of the neighbours within the sample ``x``. Of
    ``rows`` vectors in all, a query's k nearest are in proportion fewer in the sample."""
    coder = learn(x, longest)
    few = min(len(x) - 1, max(1, k * len(x) // max(1, rows)))
    if few < 1:
        return Coder(coder.centre, coder.turned, longest, BITS)
    # ids may follow clusters or copies, so the queries are drawn from the whole sample
    x = np.unique(x, axis=0)
    few = min(len(x) - 1, few)
    if few < 1:
        return Coder(coder.centre, coder.turned, longest, BITS)
    drawn = np.random.default_rng(5).permutation(len(x))[:SAMPLE_QUERIES]
    q = x[drawn]
    score = q @ x.T
    score[np.arange(len(q)), drawn] = -np.inf
    near = np.argpartition(-score, few - 1, axis=1)[:, :few]
    apart = np.bitwise_count(coder.query_codes(q)[:, None, :] ^ coder.codes(x)[near]).sum(axis=2)
    return Coder(coder.centre, coder.turned, longest, int(np.ceil(np.quantile(apart, COVER))))


class Index:
    """Posting lists of one block's codes, by substring."""

    def __init__(self, coder: Coder, ids: np.ndarray, x: np.ndarray):
        self.coder, self.ids, self.x = coder, ids, x
        codes = coder.codes(x)
        self.whole = np.ascontiguousarray(codes).view(np.uint64).ravel()
        self.order = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(PARTS)]
        self.first = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        self.found: dict[tuple[int, int, int], np.ndarray] = {}
        self.repeats = len(np.unique(ids)) < len(ids)

    def _probe(self, part: int, key: int, radius: int) -> np.ndarray:
        """All rows whose substring is within ``radius`` of ``key``."""
        at = part, key, radius
        if at not in self.found:
            order, first = self.order[part], self.first[part]
            self.found[at] = np.concatenate([order[first[k]:first[k + 1]] for k in _probes()[radius][key]])
        return self.found[at]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``."""
        r, a = divmod(min(radius, BITS), PARTS)
        hit = np.zeros(len(self.ids), dtype=bool)
        for part in range(PARTS):
            reach = r if part <= a else r - 1
            if reach >= 0:
                hit[self._probe(part, int(code[part]), reach)] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.whole[rows] ^ code.view(np.uint64)[0]) <= radius]

    def nearest(self, own: int, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best among the codes within the radius, nearest first."""
        radius = self.coder.radius
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != own]
            score = (self.x[rows] * q).sum(axis=1)
            if self.repeats:  # of rows with the same vec_id the best counts
                order = np.lexsort((-score, self.ids[rows]))
                own_best = order[np.unique(self.ids[rows][order], return_index=True)[1]]
                rows, score = rows[own_best], score[own_best]
            if len(rows) >= k or radius >= BITS:
                break
            radius += PARTS
        if len(rows) > 2 * k:
            keep = score >= np.partition(score, -k)[-k]
            rows, score = rows[keep], score[keep]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def usable(vector: Column, size: int) -> Column:
    fit = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & fit & F.exists(vector, lambda v: v != 0)


def search(vectors: DataFrame, queries: Column, k: int, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): of ``vectors`` (vec_id, embedding) the k with the largest inner
    product for each row where ``queries`` holds."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    if most is None or not most["size"]:
        return empty
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), most["size"])) \
        .select("vec_id", F.col("embedding").cast("array<double>").alias("x"), queries.alias("is_query"))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    longest, n, n_queries = rows.agg(F.sqrt(F.max(square)), F.count("*"), F.count_if("is_query")).first()
    if not n_queries or n < 2:
        return empty
    sample = bounded_sample(rows.select("vec_id", "x"), F.col("vec_id"), sample_rows).orderBy("vec_id", "x").collect()
    coder = fitted(np.array([r["x"] for r in sample]), longest, n, k)
    shared = spark.sparkContext.broadcast(coder)

    blocks, query_blocks = -(-n // BLOCK_ROWS), -(-n_queries // QUERY_ROWS)

    def grid(part: DataFrame, own: int, other: int, cell: Column) -> DataFrame:
        return part.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(own))) \
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))) \
            .select("vec_id", F.col("x").cast("array<float>" if compact else "array<double>").alias("x"),
                    "is_query", cell.alias("cell"))

    compact = dict(vectors.dtypes)["embedding"] == "array<float>"
    index = grid(rows.withColumn("is_query", F.lit(False)), blocks, query_blocks, F.col("own") * query_blocks + F.col("other"))
    asked = grid(rows.where("is_query"), query_blocks, blocks, F.col("other") * query_blocks + F.col("own"))

    def find(cell: pd.DataFrame) -> pd.DataFrame:
        ids, ask = cell["vec_id"].to_numpy(), cell["is_query"].to_numpy(dtype=bool)
        x = np.stack(cell["x"].to_list()).astype(np.float64)
        out: list[tuple[np.ndarray, ...]] = []
        if ask.any() and not ask.all():
            at = Index(shared.value, ids[~ask], x[~ask])
            for own, q, code in zip(ids[ask], x[ask], shared.value.query_codes(x[ask]), strict=True):
                found, score = at.nearest(own, q, code, k)
                out.append((np.full(len(found), own), found, score))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)), strict=True)))

    best = index.union(asked).groupBy("cell").applyInPandas(find, "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
