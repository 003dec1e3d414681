"""The corpus pipeline: documents in, encoded training documents out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and reread as the next stage's ``docs``. All stages but the last return the columns of
``documents``; each works on whatever its predecessor kept. Rows with nulls, empty and very
long texts pass as the stages' operators define it. Columns beyond those of ``documents`` travel packed
in one, so their names can't clash with an operator's; the last stage's results replace columns of
the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import bpe, lang_id, minhash, mixing, pii
from shoplens.llm.common import fold, prepare, rows_of, rows_without, staged, table
from shoplens.llm.queries import RANKS

#: a document whose language is recognised with less than this is rejected
MIN_LANG_SCORE = 0.4
#: and one of which less than this is known to that language, by what is known of the language's own texts
MIN_LANG_KNOWN = 0.3
#: near copies have PERCENT * union <= 100 * intersection of their five-word shingles; with so many
#: bands of 8 a pair at exactly this likeness shares none with probability 3e-5
PERCENT, BANDS = 80, 56


OWN, REST = ("doc_id", "text", "lang", "source", "n_chars"), "corpus_pipeline_rest"


def packed(stage: Callable) -> Callable:
    """``stage`` for documents with columns of any further names."""
    @wraps(stage)
    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest = [c for c in docs.columns if c not in OWN]
        if not rest:
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.select(*OWN, F.struct(*(F.col(f"`{c}`") for c in rest)).alias(REST)), sf_dir)
        made = [c for c in out.columns if c not in (*OWN, REST)]
        kept = [c for c in docs.columns if c not in made and (c in rest or c in out.columns)]
        return out.select(*(F.col(REST).getField(c).alias(c) if c in rest else c for c in kept), *made)

    return whole


@packed
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, those of doubtful language and those of none that was learned."""
    prepare(spark)
    model = lang_id.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = lang_id.predict(docs, model, known=True)
    return found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("lang_score") >= MIN_LANG_SCORE)
                       & (F.col("lang_known") >= MIN_LANG_KNOWN)) \
        .select(*docs.columns)


@packed
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near copies; of rows with equal doc_id
    and text one stays, rows without doc_id all stay."""
    prepare(spark)
    found = minhash.duplicates(docs.select("doc_id", "text"), PERCENT, BANDS)
    gone = staged(found.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    left = rows_without(docs, "doc_id", gone)
    again = staged(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("again")).count().where("count > 1")
                   .select("again"), "again")
    if again.isEmpty():
        return left
    return rows_without(left, "doc_id", again).unionByName(
        rows_of(left, "doc_id", again).dropDuplicates(["doc_id", "text"]))


@packed
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of its kinds; ``n_chars`` counts the new texts."""
    prepare(spark)
    return pii.redact(docs)


@packed
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources' words come to their targets."""
    prepare(spark)
    copies = mixing.mixed(docs).select(
        F.col("doc_id").alias("id"), F.col("source").alias("from"), F.col("size").alias("words"), "copies").distinct()
    taken = docs.withColumn("words_here", mixing.word_count(F.col("text"))).join(
        copies, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("from"))
        & (F.col("words_here") == F.col("words")))
    return taken.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))) \
        .select(*docs.columns)


@packed
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document; digests stand for the ids."""
    prepare(spark)
    return bpe.digests(docs, RANKS).drop("text")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: the stages can't be expressed in SQL; tests hold them against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
