"""Merkle manifest: against a plain tree, superblocks of several tiers, nulls, repeats, tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shoplens.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc_id, text, lang, source, n_chars):
    return H(*map(enc, (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root and, for each leaf, its levels as (left, right) siblings."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p // 8 * 8
            paths[i].append((nodes[a:p], nodes[p + 1:a + 8]))
            at[i] = p // 8
        nodes = [H(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        own[lang] = tree([leaf(*r) for r in by[lang]])
    root, above = tree([own[x][0] for x in langs])
    out = []
    for lang, up in zip(langs, above):
        for r, path in zip(by[lang], own[lang][1]):
            whole = [*path, *up]
            x = leaf(*r)
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                x = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in whole:
                x = H(*left, x, *right)
            proof = H(*(s for left, right in whole for s in (*left, *right)))
            out.append((r[0], leaf(*r), own[lang][0], root, proof, x, x == root))
    return sorted(out, key=str)


def checked(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS tree", "1 AS pos", "2 AS n", "'y' AS digest")
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.audited(docs, {"text": merkle.lowered(F.col("text"))}, where, **more)


def some(n, seed=1):
    r = random.Random(seed)
    rows = [(k * 3 + 1, r.choice(["Ab c", "no capitals", "É À", "", None, "W" * 500]), r.choice(["en", "de", None, "", "zz", "é"]),
             r.choice([None, "", "s:1"]), r.choice([None, 5, 12345])) for k in range(n)]
    return rows


@pytest.mark.parametrize("n, levels", [(1, 4), (9, 4), (300, 1), (300, 4), (700, 1), (700, 2)])
def test_equals_a_plain_tree(spark, n, levels):
    rows = some(n) + [(5000, "Solo Document", "only", None, 3)]
    rows += [(7, "Twice", "en", "s", 1)] * 3 + [(7, "twice", "en", "s", 1), (None, "No Id", "en", "s", 1), (None, None, None, None, None)]
    got = [tuple(r) for r in checked(spark, rows, levels=levels).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_one_leaf_and_none(spark):
    got = checked(spark, [(3, "A", "en", None, 1)]).collect()
    assert got[0].leaf == got[0].subroot == got[0].root and got[0].proof_sha256 == H()
    assert checked(spark, []).collect() == []


def test_paths_lead_to_the_root_and_damage_is_found(spark):
    rows = [(k, f"Text {k}", "en" if k % 3 else "de", "s", k) for k in range(200)]
    for r in checked(spark, rows, levels=1, paths=True).collect():
        assert merkle.folded(r.leaf, list(r.path)) == r.root
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0)
        assert r.proof_sha256 == H(*(s[1:] for s in r.path))


def test_hot_group_is_many_ranges(spark):
    """Rows of one key and text are dealt over superblocks like all others."""
    rows = [(None, "Same", "en", "s", 1)] * 600 + some(50)
    got = [tuple(r) for r in checked(spark, rows, levels=1).collect()]
    assert sorted(got, key=str) == plain(rows)
