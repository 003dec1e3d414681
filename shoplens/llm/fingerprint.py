"""Homomorphic multiset fingerprints of documents, in column expressions only.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide
vector: DENSE lanes of 60 bits, and SHARDS lanes of 32 bits of which one, chosen by the hash,
isn't zero. A fingerprint is the sum of its paragraphs' vectors, each lane modulo its power of
two. So it doesn't depend on the order of paragraphs, equal multisets have equal sums, and a
paragraph is inserted or deleted by adding or subtracting its vector. The dense lanes (240
bits) decide equality; a differing paragraph changes one shard only, so the share of
occupied shards that agree tells how alike two multisets are.

Defined results: null texts count as empty; an empty text has no paragraphs and the zero
fingerprint. Likeness is 1 for equal fingerprints, two empty ones included. For ``edited``,
rows with the same doc_id follow each other by text, rows without doc_id come first, after the
last row comes the first; a single row is its own successor. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DENSE, SHARDS = 4, 64
LANE_DIGITS, SHARD_DIGITS = 15, 8
LANE_MASK, SHARD_MASK = (1 << 60) - 1, (1 << 32) - 1
#: documents of a bucket of neighbours; buckets of a group of buckets
BUCKET_ROWS, GROUP = 256, 4096
#: buckets at most; rows sampled for each of their borders; code points of a sampled text
MAX_BUCKETS, PER_BORDER, HEAD_CHARS = 4096, 8, 1000


def vectors(paragraphs: Column) -> Column:
    """array<struct<lanes: array<bigint>, shard: bigint, value: bigint>> of an array of paragraphs."""

    def number(digest: Column, at: int, digits: int) -> Column:
        return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")

    def vector(h: Column) -> Column:
        return F.struct(*(number(h, 1 + LANE_DIGITS * k, LANE_DIGITS).alias(f"d{k}") for k in range(DENSE)),
                        (number(h, 61, 4) % SHARDS).alias("shard"), number(h, 53, SHARD_DIGITS).alias("value"))

    return F.transform(F.transform(paragraphs, lambda p: F.sha2(p, 256)), vector)


def summed(vecs: Column) -> Column:
    """The fingerprint struct<dense: array<bigint>, shards: array<bigint>> of paragraph vectors."""
    zero = F.lit(0).cast("long")

    def lane(k: int) -> Column:
        return F.aggregate(vecs, zero, lambda a, v: (a + v[f"d{k}"]).bitwiseAND(F.lit(LANE_MASK)))

    def shard(k: Column) -> Column:
        return F.aggregate(vecs, zero, lambda a, v: F.when(
            v["shard"] == k, (a + v["value"]).bitwiseAND(F.lit(SHARD_MASK))).otherwise(a))

    return F.struct(F.array(*map(lane, range(DENSE))).alias("dense"),
                    F.transform(F.sequence(F.lit(0), F.lit(SHARDS - 1)), shard).alias("shards"))


def paragraphs(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` (not null) as ``name``."""
    vecs = f"__{name}_vectors"
    return df.withColumn(vecs, vectors(paragraphs(F.col(text)))).withColumn(name, summed(F.col(vecs))).drop(vecs)


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the multisets' sum, or with ``sign`` -1 of a without b's paragraphs."""

    def each(x: Column, y: Column, mask: int) -> Column:
        return F.zip_with(x, y, lambda p, q: (p + F.lit(sign) * q).bitwiseAND(F.lit(mask)))

    return F.struct(each(a["dense"], b["dense"], LANE_MASK).alias("dense"),
                    each(a["shards"], b["shards"], SHARD_MASK).alias("shards"))


def rendered(f: Column) -> Column:
    """A fingerprint as lowercase hex: the dense lanes, then the shards."""

    def digits(lanes: Column, n: int) -> Column:
        return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")

    return F.concat(digits(f["dense"], LANE_DIGITS), digits(f["shards"], SHARD_DIGITS))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the share of agreeing shards among those occupied in either."""
    pairs = F.zip_with(a["shards"], b["shards"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    used = F.size(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
    return F.when(a["dense"] == b["dense"], F.lit(1.0)).otherwise(same / F.greatest(used, F.lit(1)))


def _following(firsts: DataFrame, levels: int) -> DataFrame:
    """(key, after): to each key's ``text`` that of the next key, the first key's after the last.

    Keys are taken in groups of neighbours; what follows a group's last key is the first of the
    next group, found in the same way among the groups. The last level has a millionth of the
    documents and is one partition.
    """
    if not levels:
        everything = Window.orderBy("key")
        whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return firsts.select("key", F.coalesce(F.lead("text").over(everything), F.first("text").over(whole))
                             .alias("after"))
    neighbours = Window.partitionBy("group").orderBy("key")
    placed = firsts.withColumn("group", F.expr(f"key div {GROUP}L")) \
        .select("key", "group", "text", F.lead("text").over(neighbours).alias("next"),
                F.row_number().over(neighbours).alias("number"))
    heads = placed.where("number = 1").select(F.col("group").alias("key"), "text")
    beyond = _following(heads, levels - 1).select(F.col("key").alias("group"), "after")
    return placed.join(beyond, "group").select("key", F.coalesce("next", "after").alias("after"))


def _borders(docs: DataFrame) -> list[dict]:
    """Ascending (known, id, head) at about equal numbers of rows of ``docs`` in between, from a sample.

    ``head`` is so much of a text's beginning as tells it from the sampled row before; it counts
    among rows without doc_id and among those that share one.
    """
    n = docs.count()
    buckets = min(MAX_BUCKETS, n // BUCKET_ROWS)
    if buckets < 2:
        return []
    some = docs if n <= PER_BORDER * buckets else docs.sample(False, PER_BORDER * buckets / n, seed=9)
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["head"].encode("utf-8", "surrogatepass"), r["head"])
                  for r in some.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS).alias("head"))
                  .collect())
    step, found = max(1, len(rows) // buckets), []
    for k in range(step, len(rows), step):
        (known, i, _, head), (known_before, i_before, _, before) = rows[k], rows[k - 1]
        same = 0
        if (known, i) == (known_before, i_before):
            same = 1 + next((j for j, (x, y) in enumerate(zip(head, before, strict=False)) if x != y),
                            min(len(head), len(before)))
        border = {"known": known, "id": i, "head": head[:same]}
        if not found or border != found[-1]:
            found.append(border)
    return found


def _bucket(borders: list[dict]) -> Column:
    """The number of borders at or before a row's (doc_id, text), by bisection."""
    if not borders:
        return F.lit(0).cast("long")
    steps = len(borders).bit_length()
    table = F.from_json(F.lit(json.dumps(borders)), "array<struct<known: boolean, id: bigint, head: string>>")
    own = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"),
                   F.coalesce("text", F.lit("")).alias("head"))

    def step(low: Column, width: Column) -> Column:
        reached = F.get(table, (low + width - 1).cast("int")) <= own
        return F.when(reached, low + width).otherwise(low)

    widths = F.array(*(F.lit(1 << k).cast("long") for k in reversed(range(steps))))
    return F.aggregate(widths, F.lit(0).cast("long"), step)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) by ascending doc_id; one shuffle of the texts.

    Buckets of rows that follow each other make the windows; their borders follow from the
    distribution of the ids, and of the texts where ids are null or repeated. Only the first
    rows of buckets are looked up from outside.
    """
    key = _bucket(_borders(docs))
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    order = Window.partitionBy("key").orderBy("doc_id", "text")
    rows = placed.select("*", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("number"))
    after = _following(rows.where("number = 1").select("key", "text"), 1)
    return rows.join(after, "key").select("doc_id", "text", F.coalesce("next", "after").alias("next_text"))


def edited(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text (the last half of its code points
    replaced by as many of the next document's first), and how alike they and the next one's are."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).select(
        "doc_id", "text", "next_text", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    for text, name in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        rows = fingerprint(rows, text, name)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       rendered(F.col("own")).alias("fingerprint"),
                       rendered(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                       likeness(F.col("own"), F.col("following")).alias("near_next"))


#: the same in DuckDB's SQL
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, COALESCE(LEAD(text) OVER (ORDER BY doc_id, text),
             FIRST_VALUE(text) OVER (ORDER BY doc_id, text)) AS next_text,
             ROW_NUMBER() OVER (ORDER BY doc_id, text) AS r FROM d),
e AS (SELECT *, LENGTH(text) AS n, text[1:LENGTH(text) - LENGTH(text) // 2] || next_text[1:LENGTH(text) // 2] AS edited
      FROM p),
t AS (SELECT r, 0 AS which, text AS x FROM e UNION ALL SELECT r, 1, edited FROM e UNION ALL SELECT r, 2, next_text FROM e),
h AS (SELECT r, which, UNNEST(LIST_TRANSFORM(STRING_SPLIT(x, CHR(10)), lambda y: SHA256(y))) AS h FROM t WHERE x <> ''),
dense AS (SELECT r, which, STRING_AGG(v, '' ORDER BY k) AS dense FROM (
  SELECT r, which, k, PRINTF('%015x', CAST(SUM(CAST('0x' || h[15 * k + 1:15 * k + 15] AS BIGINT)) % {LANE_MASK + 1} AS BIGINT)) AS v
  FROM h, RANGE({DENSE}) AS q(k) GROUP BY ALL) GROUP BY ALL),
shard AS (SELECT r, which, CAST('0x' || h[61:64] AS BIGINT) % {SHARDS} AS k,
                 CAST(SUM(CAST('0x' || h[53:60] AS BIGINT)) % {SHARD_MASK + 1} AS BIGINT) AS v FROM h GROUP BY ALL),
f AS (SELECT r, which, dense, STRING_AGG(PRINTF('%08x', COALESCE(v, 0)), '' ORDER BY k) AS shards FROM (
  SELECT r, which, dense, k, v FROM (SELECT r, which, COALESCE(dense, REPEAT('0', {DENSE * LANE_DIGITS})) AS dense, k
    FROM t LEFT JOIN dense USING (r, which), RANGE({SHARDS}) AS q(k)) LEFT JOIN shard USING (r, which, k)) GROUP BY ALL),
near AS (SELECT a.r, b.which, CASE WHEN a.dense = b.dense THEN 1.0::DOUBLE ELSE
  LIST_SUM(LIST_TRANSFORM(RANGE({SHARDS}), lambda k: CASE WHEN a.shards[8 * k + 1:8 * k + 8] = b.shards[8 * k + 1:8 * k + 8]
    AND a.shards[8 * k + 1:8 * k + 8] <> '00000000' THEN 1 ELSE 0 END))::DOUBLE /
  GREATEST(1, LIST_SUM(LIST_TRANSFORM(RANGE({SHARDS}), lambda k: CASE WHEN a.shards[8 * k + 1:8 * k + 8] <> '00000000'
    OR b.shards[8 * k + 1:8 * k + 8] <> '00000000' THEN 1 ELSE 0 END)))::DOUBLE END AS near
  FROM f a JOIN f b ON a.r = b.r AND a.which = 0 AND b.which > 0)
SELECT doc_id, n AS n_chars, SHA256(edited) AS edited_sha256, a.dense || a.shards AS fingerprint,
       b.dense || b.shards AS edited_fingerprint, x.near AS near_edited, y.near AS near_next
FROM e JOIN f a ON a.r = e.r AND a.which = 0 JOIN f b ON b.r = e.r AND b.which = 1
JOIN near x ON x.r = e.r AND x.which = 1 JOIN near y ON y.r = e.r AND y.which = 2
"""
