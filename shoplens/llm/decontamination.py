"""Benchmark decontamination by a prefix-filtered set join, in column expressions only.

A window is WINDOW consecutive words of an item, or all of a shorter item's. A document contains
it only if it contains all its shingles of SHINGLE words, each at its place. So one shingle of
a window is prefix enough: the one that is rarest in the documents.

1. Shingles are ordered by rarity: a pass over all documents counts the windows' shingles. A
   window with one that occurs nowhere is done with.
2. A second pass finds the places of prefix shingles only, each with the words around it.
3. Prefix shingles are joined to their windows. A place must leave room for the window before it
   and behind it in the document (positional and length bounds); then the words that stand
   there are compared with the whole window.
4. The spans found are merged by document, and the windows give their items.

Both passes drop most places by a filter of FILTER_WORDS * 64 bits at most before anything is
shuffled; with more shingles it drops fewer, and the join decides. Windows that several items
share, or that an item repeats, are looked up once.

Defined results: a null text has no words. Repeated rows of a document have equal results, each
its own row. Items of one id count once; items without id make words hit, but are neither
counted nor listed. An empty benchmark hits nothing, no documents give no rows. Other columns of
both tables are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import staged

WINDOW, SHINGLE = 10, 3
#: a word is a run of what isn't in this class, once A-Z are lower-cased
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same without lower-casing
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: 64-bit words of the filter at most (1 MB), and bits for each shingle below that
FILTER_WORDS, BITS_PER_SHINGLE = 1 << 17, 32


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ``lower`` does that for plain ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def with_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``words``, the words of ``text``, in its place."""
    cut = rows.withColumn("words", F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN)).drop(text)
    # only the first and the last piece can be empty
    first = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)
    last = F.when(F.get("words", F.size("words") - 1) == "", 1).otherwise(0)
    return cut.withColumn("words", F.slice("words", first + 1, F.greatest(F.size("words") - first - last, F.lit(0))))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def windows_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (window_id, words, size) of ``items`` (item_id, text), and (window_id, item_id)."""
    cut = with_words(items).where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(WINDOW)))
    each = cut.select("item_id", "size", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at")) \
        .select("item_id", "size", F.slice("words", F.col("at"), F.col("size")).alias("words")).distinct()
    each = staged(each, "windows-of-items")
    distinct = staged(each.select("words", "size").distinct()
                      .withColumn("window_id", F.monotonically_increasing_id()), "windows")
    members = each.where("item_id IS NOT NULL").join(distinct, ["words", "size"]).select("window_id", "item_id")
    return distinct, staged(members, "windows-members")


def shingles_of(windows: DataFrame) -> DataFrame:
    """(window_id, words, size, n, at, shingle): the shingles of n words, SHINGLE or the whole of a shorter window."""
    n = F.least("size", F.lit(SHINGLE))
    return windows.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0), F.col("size") - n)).alias("at")) \
        .withColumn("shingle", _joined(F.slice("words", F.col("at") + 1, F.col("n"))))


def _bit(shingle_words: list[Column], bits: int) -> Column:
    return F.xxhash64(*shingle_words).bitwiseAND(F.lit(bits - 1))


def filter_of(shingles: DataFrame, n: int) -> tuple[Column, int]:
    """A bit for each hash of ``shingles`` (shingle, of n words) as one array, and its number of bits."""
    most = shingles.count() * BITS_PER_SHINGLE
    bits = 64 * min(FILTER_WORDS, max(16, 1 << (most // 64).bit_length()))
    words = F.split("shingle", " ")
    at = shingles.select(_bit([F.get(words, F.lit(k)) for k in range(n)], bits).alias("bit"))
    slots = at.groupBy(F.shiftright("bit", 6).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("set"))
    whole = shingles.sparkSession.range(bits // 64).join(slots, F.col("id") == F.col("slot"), "left") \
        .agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("set", F.lit(0)).alias("set")))).alias("all"))
    return whole.select(F.transform("all", lambda x: x["set"])).scalar(), bits


def places(docs: DataFrame, shingles: DataFrame, n: int) -> DataFrame:
    """Where ``docs`` (words and more) may have one of ``shingles`` (shingle, of n words): ``place`` from 0 and
    ``shingle``; what isn't among them is mostly left out."""
    table, bits = filter_of(shingles, n)
    rows = docs.select("*", F.posexplode(F.arrays_zip(
        *(F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))).alias(f"w{k}") for k in range(n)))))
    parts = [F.col("col")[f"w{k}"] for k in range(n)]
    bit = _bit(parts, bits)
    known = F.getbit(F.get(table, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.where(parts[-1].isNotNull() & known) \
        .withColumn("shingle", F.concat_ws(" ", *parts)).withColumnRenamed("pos", "place").drop("col")


def prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(window_id, words, size, n, at, shingle) of each window's rarest shingle in ``docs`` (text). Windows with a
    shingle that occurs nowhere are left out."""
    shingles = shingles_of(windows)
    counted = None
    for n in sizes:
        own = shingles.where(F.col("n") == n).select("shingle").distinct()
        found = places(with_words(docs), own, n).groupBy("shingle").agg(F.count("*").alias("rows")).withColumn("n", F.lit(n))
        counted = found if counted is None else counted.unionByName(found)
    order = F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "shingle", "at")
    rarest = shingles.join(counted, ["n", "shingle"], "left").groupBy("window_id").agg(F.min(order).alias("rarest")) \
        .where("rarest.rows > 0").select("window_id", "rarest.at", "rarest.shingle")
    return staged(windows.join(rarest, "window_id").withColumn("n", F.least("size", F.lit(SHINGLE))), "prefixes")


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Equal for rows of equal id and text only."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))
                          .cast("binary"), 256))


def occurrences(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, start, size, window_id) of every window of ``items`` in ``docs`` (doc_id, text), ``doc`` being
    ``document_key``; and (window_id, item_id)."""
    windows, members = windows_of(items)
    docs = docs.select("doc_id", "text")
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # SHINGLE at most
    found = docs.sparkSession.createDataFrame([], "doc binary, start int, size int, window_id long")
    if not sizes:
        return found, members
    prefix = prefixes(docs.select("text"), windows, sizes)
    for n in sizes:
        own = prefix.where(F.col("n") == n).select("window_id", "size", "at", "shingle", F.col("words").alias("window"))
        if own.isEmpty():
            continue
        cut = with_words(docs.withColumn("doc", document_key())).select("doc", "words")
        seen = F.greatest(F.col("place") - (WINDOW - n), F.lit(0))
        around = places(cut, own.select("shingle").distinct(), n).select(
            "doc", "shingle", "place", seen.alias("seen"), F.size("words").alias("n_words"),
            F.slice("words", seen + 1, F.lit(2 * WINDOW - n)).alias("around"))
        start = F.col("place") - F.col("at")
        hits = around.join(own, "shingle").where((start >= 0) & (start + F.col("size") <= F.col("n_words"))) \
            .where(F.slice("around", start - F.col("seen") + 1, F.col("size")) == F.col("window"))
        found = found.unionByName(hits.select("doc", start.alias("start"), "size", "window_id"))
    return staged(found.distinct(), "window-hits"), members


def covered(hits: DataFrame) -> DataFrame:
    """(doc, n_hit): words of a document in the union of its spans."""
    spans = hits.groupBy("doc", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest("start", F.max("end").over(before))  # greatest skips the first row's null
    return spans.select("doc", F.greatest(new, F.lit(0)).alias("new")).groupBy("doc").agg(F.sum("new").cast("long").alias("n_hit"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated) of each row of ``docs``; ``item_ids`` are sorted texts."""
    hits, members = occurrences(docs, items)
    listed = hits.select("doc", "window_id").distinct().join(members, "window_id") \
        .groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = covered(hits).join(listed, "doc", "left")
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", n_words.alias("n_words"), document_key().alias("doc"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(found, "doc", "left").select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


#: the same rows in DuckDB's SQL: every window against every run of as many words
ORACLE_SQL = rf"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, '{CAPITALS}', '{CAPITALS.lower()}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, w, CAST(least({WINDOW}, len(w)) AS INT) AS n, unnest(range(len(w) - least({WINDOW}, len(w)) + 1)) AS k
  FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k + 1:k + n], ' ') AS x FROM p),
d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, COALESCE(regexp_extract_all(translate(text, '{CAPITALS}', '{CAPITALS.lower()}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
g AS (SELECT r, n, w, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
h AS (SELECT r, k, g.n, item_id FROM (SELECT r, n, k, array_to_string(w[k + 1:k + n], ' ') AS x FROM g) g
  JOIN win ON g.n = win.n AND g.x = win.x),
c AS (SELECT r, COUNT(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM h) GROUP BY r),
m AS (SELECT r, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
  SHA256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN m ON d.r = m.r
"""
