"""Merkle manifest of a dataset: subroots by group, proofs of all rows, checks of changed rows.

Every row is a leaf. Within a group the leaves ascend by key; while several nodes remain, each
run of RUN consecutive ones becomes the digest of their digests (a last run may be shorter, even
one node). What remains is the group's subroot; the subroots, by group, are folded the same way.

The trees are cut into superblocks of RUN ** LEVELS consecutive nodes. Upwards each superblock
is reduced to its top node, and the tops are the nodes of the next tier, until one is left in
each group; the same goes for the tree of subroots. Downwards a tier's nodes are cogrouped by
superblock with the one row of outer nodes that their top needs on its way to the root. That
task reduces its superblock once more, joins the inner siblings to the outer ones, and folds
each node's path. A task never holds more than a superblock and one path, whatever the
sizes of groups.

Positions come from a range partitioning by (group, key, leaf, row number): a group that
holds most rows is many ranges, and so are equal keys and equal rows.

Defined results: rows of equal key are ordered by leaf digest; null keys come first, the null
group before all others. Repeated rows are leaves each. A null field is ``-``, so it differs from
an empty one. An empty table has no leaves and no root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import staged

RUN = 8
#: levels of a superblock: 4096 leaves
LEVELS = 4
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NODE = "tree string, pos long, n long, digest string"
#: ``path`` has a string a level: the node's place in its run, then its siblings' digests
OUTER = "tree string, pos long, path array<string>, subroot string, root string"


def digest_of(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """SHA-256 of fields, each with its length in bytes in front, or ``-`` for null."""
    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


def levels_of(digests: list[str], n: int, most: int) -> list[list[str]]:
    """The nodes of a superblock level by level, in a tree of ``n`` nodes at the lowest."""
    out = [digests]
    while n > 1 and len(out) <= most:
        digests = [digest_of(digests[k:k + RUN]) for k in range(0, len(digests), RUN)]
        out.append(digests)
        n = -(-n // RUN)
    return out


def steps_of(levels: list[list[str]]) -> list[list[str]]:
    """For each level but the top, each node's step of a path: its place, then its siblings."""
    def step(nodes: list[str], j: int) -> str:
        at = j % RUN
        run = nodes[j - at:j - at + RUN]
        return f"{at}" + "".join(run[:at] + run[at + 1:])

    return [[step(nodes, j) for j in range(len(nodes))] for nodes in levels[:-1]]


def folded(digest: str, path: list[str]) -> str:
    """The digest at the end of a path that starts at ``digest``."""
    for step in path:
        left = 1 + HEX * int(step[0])
        digest = digest_of([step[1:left], digest, step[left:]])
    return digest


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place within ``tree`` by ``order`` (unique), and ``n``, the tree's rows."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-ranged") \
        .withColumn("part", F.shiftright("at", 33))
    # one row for each range that a tree has rows in
    runs = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    starts = staged(runs.select("tree", "part", (F.sum("rows").over(tree.orderBy("part")) - F.col("rows")
                                                 - F.col("first")).alias("shift"),
                                F.sum("rows").over(tree).alias("n")), "merkle-ranges")
    return ranged.join(starts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")) \
        .drop("at", "part", "shift")


def _block(levels: int) -> Column:
    return F.expr(f"pos div {RUN ** levels}")


def tiers_of(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` (tree, pos, n, digest and more) and the tops above them, up to one node for each tree."""
    def top(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        last = levels_of(block["digest"].tolist(), n, levels)[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // RUN ** levels)], "digest": last})

    tiers = [nodes]
    while len(tiers) == 1 or tiers[-1].agg(F.max("n")).first()[0] > 1:
        below = tiers[-1].select("tree", "pos", "n", "digest")
        tiers.append(staged(below.groupBy("tree", _block(levels).alias("block")).applyInPandas(top, NODE), "merkle-tops"))
    return tiers


def exchanged(nodes: DataFrame, outer: DataFrame, schema: str, levels: int, finish) -> DataFrame:
    """Cogroups ``nodes`` by superblock with the outer nodes of its top. ``finish`` gets the nodes of
    a superblock in order, their inner paths and the row of ``outer``."""
    def joined(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        block = block.sort_values("pos")
        steps = steps_of(levels_of(block["digest"].tolist(), int(block["n"].iloc[0]), levels))
        inner = [[level[i // RUN ** k] for k, level in enumerate(steps)] for i in range(len(block))]
        return finish(block, inner, above.iloc[0])

    return nodes.groupBy("tree", _block(levels).alias("block")) \
        .cogroup(outer.groupBy("tree", "pos")).applyInPandas(joined, schema)


def outer_of(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The paths (OUTER) of the nodes of the second tier, from those of the last one."""
    def paths(block: pd.DataFrame, inner: list[list[str]], above: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "path": [[*p, *above["path"]] for p in inner],
                             "subroot": above["subroot"], "root": above["root"]})

    for nodes in reversed(tiers[1:-1]):
        tops = staged(exchanged(nodes, tops, OUTER, levels, paths), "merkle-outer")
    return tops


def manifest(leaves: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The tiers above ``leaves`` (tree, pos, n, digest and more) and the outer nodes (OUTER) of the first."""
    tiers = tiers_of(leaves, levels)
    subroots = staged(numbered(tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"),
                               "name"), "merkle-subroots")
    forest = tiers_of(subroots, levels)
    root = forest[-1].select("tree", "pos", F.array().cast("array<string>").alias("path"),
                             F.lit("").alias("subroot"), F.col("digest").alias("root"))

    def named(block: pd.DataFrame, inner: list[list[str]], above: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tree": block["name"], "pos": 0, "path": [[*p, *above["path"]] for p in inner],
                             "subroot": block["digest"], "root": above["root"]})

    tops = staged(exchanged(subroots, outer_of(forest, root, levels), OUTER, levels, named), "merkle-outer")
    return tiers, outer_of(tiers, tops, levels)


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case, all else as it is."""
    return F.translate(text, CAPITALS, CAPITALS.lower())


def leaves_of(rows: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None,
              fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang") -> DataFrame:
    """(key, tree, pos, n, digest, other): a leaf for each row; ``other`` is the leaf of the row as
    ``changed`` (new columns by field) has it, where ``where`` holds, else null."""
    other = leaf_of(*((changed or {}).get(f, F.col(f)) for f in fields))
    made = rows.select(F.col(key).alias("key"), F.concat(F.lit("="), F.col(group)).alias("tree"),
                       leaf_of(*map(F.col, fields)).alias("digest"),
                       (F.when(where, other) if where is not None else F.lit(None).cast("string")).alias("other"),
                       F.monotonically_increasing_id().alias("row"))
    made = staged(made.withColumn("tree", F.coalesce("tree", F.lit(""))), "merkle-leaves")
    return staged(numbered(made, "key", "digest", "row"), "merkle-numbered")


def audited(rows: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None,
            fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", levels: int = LEVELS,
            paths: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, and its ``path`` if asked for.

    ``proof_sha256`` is the digest of the row's siblings from its own level up to the root, ``folded_root``
    the root that its path gives from the changed leaf, where there is one, else from the leaf.
    """
    leaves = leaves_of(rows, changed, where, fields, key, group)
    kind = dict(rows.dtypes)[key]
    schema = (f"{key} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean" + ", path array<string>" * paths)
    if leaves.isEmpty():
        return rows.sparkSession.createDataFrame([], schema)

    def finish(block: pd.DataFrame, inner: list[list[str]], above: pd.Series) -> pd.DataFrame:
        outer, root = list(above["path"]), above["root"]
        outside = "".join(step[1:] for step in outer)

        def ends() -> Iterator[tuple]:
            for leaf, other, path in zip(block["digest"], block["other"], inner, strict=True):
                proof = digest_of([step[1:] for step in path] + [outside])
                end = folded(leaf if other is None else other, [*path, *outer])
                yield (leaf, above["subroot"], root, proof, end, end == root, *([[*path, *outer]] * paths))

        out = pd.DataFrame(list(ends()), columns=[c.split()[0] for c in schema.split(", ")[1:]])
        out.insert(0, key, block["key"].to_numpy())
        return out

    tiers, outer = manifest(leaves, levels)
    return exchanged(tiers[0], outer, schema, levels, finish)


def _oracle(depth: int) -> str:
    """The same rows in DuckDB's SQL, level by level; RUN ** depth leaves of a group at most."""
    def part(c: str) -> str:
        return f"COALESCE(OCTET_LENGTH(ENCODE(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"SHA256({' || '.join(part(c) for c in FIELDS[:-1])} || {part(text)})"

    crc = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform("
           "string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
           "lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), "
           "4294967295)")
    lines = [f"""WITH docs AS (
  SELECT doc_id, COALESCE('=' || lang, '') AS tree, {leaf('text')} AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")} END AS other
  FROM documents),
a0 AS (SELECT *, ROW_NUMBER() OVER w - 1 AS p, COUNT(*) OVER (PARTITION BY tree) AS n, leaf AS x,
              COALESCE(other, leaf) AS f, '' AS proof FROM docs
       WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf)),
n0 AS (SELECT DISTINCT tree, p, n, x FROM a0)"""]

    def climb(k: int, a: str, n: str) -> tuple[str, str]:
        lines.append(f"""r{k} AS (SELECT tree, p // {RUN} AS q, any_value(n) AS m, list(x ORDER BY p) AS l FROM {n} GROUP BY ALL),
n{k + 1} AS (SELECT tree, q AS p, (m + {RUN - 1}) // {RUN} AS n,
             CASE WHEN m > 1 THEN SHA256(array_to_string(l, '')) ELSE l[1] END AS x FROM r{k}),
a{k + 1} AS (SELECT a.* EXCLUDE (p, n, f, proof), a.p // {RUN} AS p, (n + {RUN - 1}) // {RUN} AS n,
  CASE WHEN n > 1 THEN SHA256(array_to_string(l[:a.p % {RUN}], '') || f || array_to_string(l[a.p % {RUN} + 2:], ''))
       ELSE f END AS f,
  CASE WHEN n > 1 THEN proof || array_to_string(l[:a.p % {RUN}], '') || array_to_string(l[a.p % {RUN} + 2:], '')
       ELSE proof END AS proof
  FROM {a} a JOIN r{k} r ON a.tree = r.tree AND a.p // {RUN} = r.q)""")
        return f"a{k + 1}", f"n{k + 1}"

    a, n = "a0", "n0"
    for k in range(depth):
        a, n = climb(k, a, n)
    lines.append(f"""s AS (SELECT tree AS name, x AS subroot, ROW_NUMBER() OVER (ORDER BY tree) - 1 AS p, COUNT(*) OVER () AS n
  FROM {n}),
b AS (SELECT doc_id, leaf, subroot, '' AS tree, s.p, s.n, subroot AS x, f, proof FROM {a} a JOIN s ON a.tree = s.name),
m AS (SELECT '' AS tree, p, n, subroot AS x FROM s)""")
    a, n = "b", "m"
    for k in range(depth, depth + 4):
        a, n = climb(k, a, n)
    return ",\n".join(lines) + f"""
SELECT doc_id, leaf, subroot, {n}.x AS root, SHA256(proof) AS proof_sha256, f AS folded_root, f = {n}.x AS verified
FROM {a}, {n}"""


#: up to 8 ** 6 documents a language and 8 ** 4 languages
ORACLE_SQL = _oracle(6)
