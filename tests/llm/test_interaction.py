"""Filter interactions: every order applied to every document, by hand."""

import random
import re
from itertools import permutations

from shoplens.llm import interaction

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    def fails(doc):
        text = doc[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [d[0] for d in docs if (d[1] or "") == text and d[0] is not None]
        return {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search("[#$%&*|]", text)), doc[0] is not None and doc[0] > min(copies))) if bad}

    good = {x[0] for x in labels if x[1] == 1} - {None}
    toxic = {x[0] for x in labels if x[2] == 1} - {None}
    out = {}
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], fails(d)) for d in docs if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f]
        for key in [key for key in out if key[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return out


def run(spark, docs, labels):
    docs = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS part", "1 AS bits", "0 AS n", "7 AS good", "8 AS words")
    labels = spark.createDataFrame(labels, LABELS).selectExpr("*", "1 AS n", "'y' AS part")
    return interaction.audit(docs, labels).collect()


def test_equals_orders_applied_to_documents(spark):
    r = random.Random(3)
    many = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", " \t\n", "A" * 5, "word " * 300, many, many + " #", many + " X" * 40, " ".join("ab" for _ in range(220)),
             "é \U0001F600 " * 150, "x" * 100_000, many.upper(), "\u001f a b", f" {many}\x0b"]
    docs = [(r.choice([None, *range(40)]), r.choice(texts), r.choice(["en", "de", None, ""])) for _ in range(300)]
    docs += [docs[0], docs[1], (99, "x" * 100_000, "one"), (5, None, "en"), (5, "", "en")]
    labels = [(r.choice([None, *range(50)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)]
    got, want = run(spark, docs, labels), plain(docs, labels)
    assert len(got) == len(want) == 600 * 4
    assert {tuple(x)[:3]: list(x)[3:] for x in got} == want


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == []
    got = run(spark, [(1, "a b", None)], [])
    assert len(got) == 600 and {x.part for x in got} == {""} and {x.good_lost for x in got} == {0}
