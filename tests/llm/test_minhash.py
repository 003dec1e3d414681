"""MinHash near-duplicates against brute force; components against union-find."""

import random
import re

import pytest

from shoplens.llm import common, minhash
from shoplens.llm.components import components


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    found = {i: sets_of(t) for i, t in rows}
    top = {i: i for i in found}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(found)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(found[a] & found[b])
            if both and 100 * both >= 85 * len(found[a] | found[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(found[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, groups, copies, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.duplicates(docs).collect()}


def test_shingles_are_those_of_the_words():
    for text in ("A b\tc D e f", "a", "", None, "a  b", "x y z w v " * 3, "É é\x0bA", " lead and trail  ", "a b c d e"):
        assert len(minhash.shingles(text)) == len(sets_of(text)), text
    assert (minhash.shingles("One two\nthree four FIVE") == minhash.shingles("one  two three four five")).all()
    assert len(minhash.shingles("no-break\xa0stays one word")) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed, 40, 6, 3)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two"), (1005, "a " * 3000)]
    assert got(spark, rows) == brute(rows)


def test_one_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = corpus(5, 3, 60, 4)
    assert got(spark, rows) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS kept", "'x' AS component_id")
    out = sorted(minhash.duplicates(docs).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in out] == [
        (5, 5, True), (5, 5, True), (7, 5, False), (None, None, True), (None, None, True)]
    assert minhash.duplicates(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    edges += [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    top = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {x: root(x) for x in top}
    assert components(df.limit(0)).collect() == []


def test_rows_by_a_filter_without_python_workers(spark):
    """Rows picked by many ids: repeated keys, nulls; no second set of workers beside an operator's own."""
    df = spark.range(-50, 9000).selectExpr("CASE WHEN id % 100 <> 7 THEN id END AS k", "id % 3 AS x").unionByName(
        spark.createDataFrame([(5, 9), (5, 9), (1 << 62, 9), (None, 9)], "k long, x long"))
    rows = sorted(df.collect(), key=str)
    for wanted in ([], [5], [*range(-50, 6000, 5), 1 << 62]):
        ids = spark.createDataFrame([(k,) for k in wanted], "of long")
        some, rest = common.rows_of(df, "k", ids), common.rows_without(df, "k", ids)
        assert sorted(some.collect(), key=str) == [r for r in rows if r.k in set(wanted)]
        assert sorted(rest.collect(), key=str) == [r for r in rows if r.k not in set(wanted)]
        for found in (some, rest):
            assert found.columns == df.columns and "Python" not in found._jdf.queryExecution().toString()
