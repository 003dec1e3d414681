"""Interaction audit of text filters: what each removes at each place of each order.

Five filters fail a document on its text: A few words, B repeated words, C capitals, D signs,
E a text that a smaller doc_id has already. Documents are counted by part and by the 2^5
patterns of failures, as well as those with a good quality label and those with a toxic one.

All else is contracted from these counts. For each part they are a 2x2x2x2x2 tensor, index 1
of an axis for a failure. A step of an order gives each axis one of three vectors: pass [1, 0],
fail [0, 1] or all [1, 1]; one einsum over the parts of a batch and the distinct choices of
vectors gives all numbers. So orders are never applied to documents, only to 32 counts a part.

E needs the smallest doc_id of each text. Rows are first counted by (text digest, doc_id, ...),
then by (text digest, part, ...) with the rows at the smallest id, so neither a text with a third
of all rows nor a repeated row meets in one task, and there is no join on texts.

Defined results: a null text is an empty one; a null or empty part is "". Rows without doc_id
never fail E and make no other row fail it. Repeated rows count each, and don't fail E for
one another. A doc_id with several labels has each of them. An empty table gives no rows.
Columns other than doc_id, text and the part are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: fixed values of the filters
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
BLANKS = " \t\n\x0b\f\r"
#: parts contracted together
BATCH_PARTS = 2000

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def failures(text: Column) -> tuple[Column, Column, Column, Column]:
    """Whether a text (not null) fails A, B, C and D; ``words_of`` holds its words."""
    words = F.col("words")
    n = F.size(words)
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
            100 * capitals > MOST_CAPITALS * F.char_length(text), F.regexp_like(text, F.lit(SIGNS)))


def words_of(text: Column) -> Column:
    """Runs of anything but blanks."""
    inside = F.btrim(text, F.lit(BLANKS))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, r"[\x20\x09-\x0D]+"))


def patterns(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, pattern, n, good, toxic): documents by part and failures; bit k of ``pattern`` is FILTERS[k]."""
    text = F.col("t")
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t")) \
        .withColumn("words", words_of(text))
    bits = sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate(failures(text))), F.lit(0))
    each = rows.select("doc_id", "part", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), bits.alias("bits")) \
        .groupBy("digest", "doc_id", "part", "bits").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    # rows without doc_id have no label; they stay out of the join, where they would be one key
    none = F.lit(0)
    known = each.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").withColumns(
        {"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    marked = known.unionByName(each.where("doc_id IS NULL").withColumns({"good": none, "toxic": none}))
    some = marked.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without"))
    # by text: a row for each part, failure and label at most
    split = some.withColumn("first", F.min("least").over(Window.partitionBy("digest"))).withColumn(
        "first_ones", F.col("without") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0))
    repeated = 1 << FILTERS.index("E")
    counted = split.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("bits").alias("pattern"), F.col("first_ones").alias("rows")),
        F.struct((F.col("bits") + repeated).alias("pattern"), (F.col("n") - F.col("first_ones")).alias("rows")))))
    return counted.where("rows > 0").groupBy("part", "pattern").agg(
        F.sum("rows").alias("n"), F.sum(F.col("good") * F.col("rows")).alias("good"),
        F.sum(F.col("toxic") * F.col("rows")).alias("toxic"))


def contracted(counts: np.ndarray, choices: list[tuple]) -> np.ndarray:
    """``counts`` (.., 2, 2, 2, 2, 2) contracted with a vector for each axis, by choice: (.., choices)."""
    by_axis = np.array(choices, dtype=np.int64).reshape(len(choices), len(FILTERS), 2).transpose(1, 0, 2)
    return np.einsum("...abcde,ka,kb,kc,kd,ke->...k", counts, *by_axis, optimize="greedy")


def _choice(passed: str, failed: str = "") -> tuple:
    return tuple(FAIL if f in failed else PASS if f in passed else ALL for f in FILTERS)


def interactions(counts: np.ndarray) -> pd.DataFrame:
    """The result's rows but for ``part``, part by part, of ``counts`` (parts, 3, 2, 2, 2, 2, 2): all documents,
    good ones and toxic ones."""
    steps = [("".join(order), k, f, "".join(sorted(order[:k]))) for order in permutations(FILTERS)
             for k, f in enumerate(order)]
    wanted = {c: k for k, c in enumerate(dict.fromkeys(
        c for _, _, f, before in steps
        for c in (_choice(before + f), _choice(before, f), _choice("", f), _choice(FILTERS.replace(f, ""), f))))}
    found = contracted(counts, list(wanted))

    def column(measure: int, choices: list[tuple]) -> np.ndarray:
        return found[:, measure][:, [wanted[c] for c in choices]]

    removed = column(0, [_choice(before, f) for _, _, f, before in steps])
    of = np.array([f for _, _, f, _ in steps])
    shapley = np.empty_like(removed)
    for f in FILTERS:
        shapley[:, of == f] = removed[:, of == f].sum(axis=1, keepdims=True)
    columns = {
        "kept": column(0, [_choice(before + f) for _, _, f, before in steps]),
        "removed": removed,
        "redundant": column(0, [_choice("", f) for _, _, f, _ in steps]) - removed,
        "unique_fails": column(0, [_choice(FILTERS.replace(f, ""), f) for _, _, f, _ in steps]),
        "good_lost": column(1, [_choice(before, f) for _, _, f, before in steps]),
        "toxic_lost": column(2, [_choice(before, f) for _, _, f, before in steps]),
        "shapley": shapley}
    n = len(counts)
    return pd.DataFrame({"filter_order": [s[0] for s in steps] * n, "step": np.tile([s[1] + 1 for s in steps], n).astype("int32")}
                        | {c: v.ravel() for c, v in columns.items()})


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    cells = patterns(docs, labels, part).groupBy("part").agg(
        F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axes = tuple(reversed(range(2, 2 + len(FILTERS))))  # bit 0, the last axis when reshaped, is A
        for batch in batches:
            for at in range(0, len(batch), BATCH_PARTS):
                some = batch.iloc[at:at + BATCH_PARTS]
                flat = np.zeros((len(some), 3, 1 << len(FILTERS)), dtype=np.int64)
                for k, cell in enumerate(some["cells"]):
                    for c in cell:
                        flat[k, :, c["pattern"]] = c["n"], c["good"], c["toxic"]
                counts = flat.reshape(len(some), 3, *[2] * len(FILTERS)).transpose(0, 1, *axes)
                out = interactions(counts)
                out.insert(0, "part", np.repeat(some["part"].to_numpy(dtype=object), len(out) // len(some)))
                yield out

    return cells.mapInPandas(contract, RESULT)


def _oracle() -> str:
    """The same rows in DuckDB's SQL, each order applied to the patterns."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
    bit = " ".join(f"WHEN '{f}' THEN {1 << k}" for k, f in enumerate(FILTERS))
    return rf"""
WITH t AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM t),
l AS (SELECT doc_id, MAX(CAST(quality = 1 AS INT)) AS good, MAX(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic,
  (CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(x) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(x, '{SIGNS}') THEN 8 ELSE 0 END)
  + (CASE WHEN w.doc_id > MIN(w.doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END) AS bits
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, bits, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM d GROUP BY ALL),
o AS (SELECT * FROM (VALUES {orders}) AS o(filter_order)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f,
  list_sum([CASE c {bit} END FOR c IN string_split(substr(filter_order, 1, step - 1), '')
            IF c <> '']) AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (SELECT filter_order, step, f, COALESCE(CAST(earlier AS BIGINT), 0) AS before, CASE f {bit} END AS own FROM s),
r AS (SELECT part, filter_order, step, f,
  SUM(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END) AS kept,
  SUM(CASE WHEN bits & before = 0 AND bits & own > 0 THEN n ELSE 0 END) AS removed,
  SUM(CASE WHEN bits & before > 0 AND bits & own > 0 THEN n ELSE 0 END) AS redundant,
  SUM(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
  SUM(CASE WHEN bits & before = 0 AND bits & own > 0 THEN good ELSE 0 END) AS good_lost,
  SUM(CASE WHEN bits & before = 0 AND bits & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r"""


ORACLE_SQL = _oracle()
