"""Benchmark windows in documents: against every window at every place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shoplens.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[k:k + 10]) for k in range(max(1, len(w) - 9)) if w]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k:k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found |= {str(item)} - {"None"}
        out.append((doc_id, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string") \
        .selectExpr("*", "1 AS words", "2 AS doc", "3 AS size", "4 AS n_words", "'x' AS item_ids")
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS window_id", "2 AS words", "3 AS size")
    return sorted(map(tuple, decontamination.contaminated(docs, items).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows_at_all_places(spark, seed):
    r = random.Random(seed)
    text = lambda n, most=60: " ".join(f"{'Wé'[r.random() < .1]}{int(r.triangular(0, most, 0))}" for _ in range(n))
    items = [(k, text(r.randint(8, 30))) for k in range(25)]
    items += [(100, "Solo"), (101, "two words"), (102, "Three, little-words"), (103, ""), (104, None), (105, "?!"), (106, text(9)),
              (None, text(15)), (1, text(12)), (107, items[3][1]), (108, "again again " * 10), (109, "中文 \U0001F600x É")]
    docs = [(k, text(r.randint(0, 80))) for k in range(60)]
    for k in range(40):
        w = words(r.choice(items)[1])
        cut = r.randint(0, max(0, len(w) - 9))
        docs.append((200 + k, f"{text(5)} {r.choice([', ', ' ', chr(10)]).join(w[cut:cut + r.randint(8, 14)]).upper()}! {text(5)}"))
    docs += [(400, None), (401, ""), (402, "again " * 50), (403, items[0][1] + " " + items[0][1]), (None, items[5][1]), (404, "--Solo--"),
             (405, "x中文 \U0001F600x é"), (406, "中文 \U0001F600X É"), (None, items[6][1]), (403, items[1][1])]
    docs += docs[60:64] * 2
    assert run(spark, docs, items) == plain(docs, items)


def test_very_long_and_hot_texts(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    long = " ".join(["common line of words"] * 20_000)
    docs = [(1, f"{long} {passage} {long}"), (2, long)] + [(k, passage) for k in range(10, 200)]
    items = [(1, passage), (2, "common line of words common line of words common line of words"), (3, "absent " * 12)]
    got = {d[0]: d for d in run(spark, docs, items)}
    assert got[1] == (1, 160_030, 160_030, 2, ["1", "2"], True)
    assert got[2][1:] == (80_000, 80_000, 1, ["2"], True)
    assert all(got[k][1:] == (30, 30, 1, ["1"], True) for k in range(10, 200))


def test_a_full_filter_drops_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "FILTER_WORDS", 1)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(80)]
    docs = [(k, f"a b {items[k][1]} c") for k in range(80)] + [(100, "other words only")]
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, 0, [], False)]
    assert run(spark, [(1, "a b")], [(1, None)]) == [(1, 2, 0, 0, [], False)]


def test_no_python_on_the_path(spark):
    docs, items = (spark.createDataFrame([(1, " ".join("abcdefghijklm"))], f"{c} long, text string") for c in ("doc_id", "item_id"))
    plan = decontamination.contaminated(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert decontamination.contaminated(docs, items).where(F.col("contaminated")).count() == 1
