"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification.

A text's set holds its distinct five-word shingles (words lower-cased A-Z, split at ASCII
white space). Two permutations make all signature coordinates: the first scatters a shingle
over a circle of 2^32 places, the second is applied to that place shifted back by k for
coordinate k. Coordinates keep one byte each; eight bytes in a row are a band.

Documents with equal sets are one class, represented by the smallest doc_id. Classes that share
a band are candidates, taken in two steps, so that no group is paired out in full:
  1. each band group's most connected class is compared with every other class of the group,
     and the links found give a first set of components;
  2. groups that still hold several components are taken again, but only for pairs
     across components whose sketches come near the threshold, in blocks of bounded size.
Every link is confirmed on the full sets. Components are contracted on the cluster.

Defined results: a text without words (or null) has an empty set and is linked with nothing.
Fewer words than five make one shingle of the whole sequence. Rows that share a doc_id are one
document. A row without doc_id takes no part: its component is null and it is kept. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import rows_of, staged, with_struct
from shoplens.llm.components import components

WORDS = 5
#: link if PERCENT * union <= 100 * intersection
PERCENT = 85
BANDS, ROWS = 32, 8
#: a pair goes on to verification if this share of its sketch bytes agree: six standard
#: deviations of the estimate below the threshold
SLACK = 6.0
#: classes of a group that are paired in one block
BLOCK = 512

_RNG = np.random.default_rng(20_011)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, from one running sum over the text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    # within a word, byte i counts with the i-th power; powers begin anew at each word's start
    size = end - start
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else \
        np.concatenate([np.zeros(start[0], dtype=np.int64),
                        np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))])
    longest = int(size.max())
    power = np.full(longest, _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    value = _BYTE[data] * power[np.minimum(place, longest - 1)]
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value, dtype=np.uint64)])
    return _mix(total[end] - total[start] + size.astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingles of a text, as 64-bit hashes."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    n = min(WORDS, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = total * _STEP + words[k:len(words) - n + 1 + k]
    return np.unique(_mix(total))


def signature(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """``bands`` * ROWS coordinates, one byte each. Coordinate k is the smallest value that the second
    permutation gives to the shingles' places on the circle, shifted by k."""
    place = (found >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(bands * ROWS, dtype=np.uint32)[:, None]
    low = np.full(bands * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(place), 2048):
        x = place[None, k:k + 2048] - shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(axis=1), out=low)
    return (low & np.uint32(0xFF)).astype(np.uint8)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets are near enough."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def needed(percent: int = PERCENT, bands: int = BANDS) -> int:
    """Sketch bytes that must agree for a pair to be verified."""
    n, p = bands * ROWS, percent / 100
    return int(n * p - SLACK * (n * p * (1 - p)) ** 0.5)


def sketches(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_shingles, set_key, sketch): a digest of the set, and the
    signature as ``bands`` longs, each a band."""

    @F.pandas_udf("n_shingles long, set_key string, sketch array<long>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                found = shingles(text)
                rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest(),
                             signature(found, bands).view(np.int64) if len(found) else None))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "sketch"])

    return with_struct(docs.select("doc_id", "text"), run("text"), ("n_shingles", "set_key", "sketch")).drop("text")


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose documents' full sets are near enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # rows that share a doc_id are one document; any one of their texts that is in the class will do
    texts = staged(rows_of(docs.select(F.col("doc_id").alias("id"), "text"), "id", staged(ids.toDF("of"), "ids")),
                   "candidates")
    texts = texts.groupBy("id").agg(F.collect_set("text").alias("texts"))

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, sets = None, []
        for left, right in batches:
            out = []
            for a, b in zip(left, right, strict=True):
                a = list(a)
                if a != last:
                    last, sets = a, [shingles(t) for t in a]
                others = [shingles(t) for t in b]
                out.append(any(linked(x, y, percent) for x in sets for y in others))
            yield pd.Series(out, dtype=bool)

    member = texts.select(F.col("id").alias("b"), F.col("texts").alias("text_b"))
    leader = texts.select(F.col("id").alias("a"), F.col("texts").alias("text_a"))
    both = pairs.join(member, "b").join(leader, "a")
    return both.where(near("text_a", "text_b")).select("a", "b")


def _rows(classes: DataFrame) -> DataFrame:
    """(id, band, key) for each band of each class."""
    return classes.select("id", F.posexplode("sketch").alias("band", "value")) \
        .select("id", "band", F.xxhash64("band", "value").alias("key"))


def groups(rows: DataFrame) -> DataFrame:
    """(id, band, key, n) of the band groups of two classes or more, n being their size."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, "key").select("id", "band", "key", "n")


def star_pairs(shared: DataFrame) -> DataFrame:
    """Pairs of each group's most connected class with the others of the group, each pair once."""
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = shared.join(degree, "id")
    leader = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("top")) \
        .select("key", (-F.col("top.minus")).alias("a"))
    return shared.select("key", F.col("id").alias("b")).join(leader, "key").where("a <> b") \
        .select("a", "b").distinct()


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole cells (rows of one key, lo, hi) out of batches that are sorted by them."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        cell = batch[["key", "lo", "hi"]].to_numpy()
        cut = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
        for i, j in zip(np.concatenate([[0], cut[:-1]]), cut, strict=False):
            yield batch.iloc[i:j]
        rest = batch.iloc[cut[-1] if len(cut) else 0:]
    if rest is not None and len(rest):
        yield rest


def _near(cell: pd.DataFrame, enough: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each row of a cell, the rows it is to be compared with: of other components, with a
    sketch that comes near. A pair that shares several bands counts in the first one only."""
    sk = np.stack(cell["sketch"].to_list()).astype(np.int64)
    sk8 = sk.view(np.uint8)
    comp, block, band = cell["component"].to_numpy(), cell["block"].to_numpy(), int(cell["band"].iloc[0])
    lo, hi = cell["lo"].iloc[0], cell["hi"].iloc[0]
    rest = np.flatnonzero(block == hi)
    for k in np.flatnonzero(block == lo):
        some = rest[comp[rest] != comp[k]]
        if lo == hi:
            some = some[some > k]
        some = some[(sk8[some] == sk8[k]).sum(axis=1) >= enough]
        some = some[~(sk[some, :band] == sk[k, :band]).any(axis=1)]
        if len(some):
            yield k, some


def cross_links(classes: DataFrame, shared: DataFrame, parts: DataFrame, docs: DataFrame,
                percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """Links (a, b) across components (``parts``: node, component) between classes that share a
    group (``shared``: see groups); enough of them to join what belongs together, each confirmed on the full sets.

    A group is compared in cells, pairs of blocks of about BLOCK classes. Sketches tell which
    rows have anything to be compared with; only those get their sets, in the same cells.
    """
    placed = shared.join(parts.withColumnRenamed("node", "id"), "id", "left") \
        .withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo < hi").select("key")
    cells = placed.join(mixed, "key") \
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")) \
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))) \
        .join(classes.select("id", "sketch"), "id") \
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"),
                "band", "block", "id", "component", "sketch")
    enough = needed(percent, bands)

    def to_compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells(batches):
            use = {r for k, some in _near(cell, enough) for r in (k, *some)}
            if use:
                yield cell.iloc[sorted(use)]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells(batches):
            ids, comp = cell["id"].to_numpy(), cell["component"].to_numpy().copy()
            sets = [[np.frombuffer(x, dtype=np.uint64) for x in s] for s in cell["sets"]]
            found = []
            for k, some in _near(cell, enough):
                for j in some:
                    if comp[k] != comp[j] and any(linked(x, y, percent) for x in sets[k] for y in sets[j]):
                        found.append((ids[k], ids[j]))
                        comp[comp == comp[j]] = comp[k]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    by = ["key", "lo", "hi"]
    near = staged(cells.repartition(*by).sortWithinPartitions(*by).mapInPandas(to_compare, cells.schema), "near")

    @F.pandas_udf("binary")
    def as_set(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)

    ids = staged(near.select(F.col("id").alias("of")).distinct(), "ids")
    sets = staged(rows_of(docs.select(F.col("doc_id").alias("id"), "text"), "id", ids)
                  .select("id", as_set("text").alias("one")).groupBy("id")
                  .agg(F.collect_set("one").alias("sets")), "sets")
    return near.join(sets, "id").repartition(*by).sortWithinPartitions(*by) \
        .mapInPandas(compare, "a long, b long").distinct()


def duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text)."""
    found = staged(sketches(docs, bands), "sketches")
    known = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = known.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    # equal sets have equal sketches: one row of the class stands for it
    classes = staged(known.join(first.withColumnRenamed("set_key", "k"),
                                (F.col("doc_id") == F.col("id")) & (F.col("set_key") == F.col("k")))
                     .groupBy("id", "set_key").agg(F.first("sketch").alias("sketch")).select("id", "sketch"), "classes")
    shared = staged(groups(_rows(classes)), "groups")
    links = staged(verified(staged(star_pairs(shared), "pairs"), docs, percent), "links")
    parts = components(links)
    more = staged(cross_links(classes, shared, parts, docs, percent, bands), "links")
    if not more.isEmpty():
        parts = components(links.union(more))
    of_class = first.join(parts.withColumnRenamed("node", "id"), "id", "left") \
        .select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")) \
        .join(of_class, "set_key", "left")
    # rows that share a doc_id are one document
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: the same rows in DuckDB's SQL, from all pairs that share a shingle (small tables only)
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, UNNEST(CASE WHEN LEN(words) = 0 THEN [] WHEN LEN(words) < {WORDS} THEN [ARRAY_TO_STRING(words, ' ')]
    ELSE LIST_TRANSFORM(RANGE(1, LEN(words) - {WORDS - 2}), lambda i: ARRAY_TO_STRING(words[i:i + {WORDS - 1}], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
m AS (SELECT doc_id, MIN(other) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, COALESCE(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
