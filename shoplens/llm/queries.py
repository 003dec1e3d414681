"""The queries of the entry point: each applies one operator to its whole table and derives the
columns of its contract from what the operator returns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import (ann, bpe, decontamination, fingerprint, interaction, lang_id, merkle, minhash, mixing, pii, quality,
                          toxicity, warc)
from shoplens.llm.common import fold, table

#: a score from here on counts as label 1
DECIDED = 0.3

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS).drop("text")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, 20)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _scored(spark: SparkSession, sf_dir: str, module, label: str, score: str, parts: int, out: int) -> DataFrame:
    """A text classifier fitted to ``labels.<label>`` outside the fold ``out`` of ``parts``, on all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), parts) == out
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    model = module.fit(docs.where(~held_out), labels.where(~held_out))
    return module.predict(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(score).alias("score"),
        (F.col(score) >= DECIDED).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", "toxicity", 4, 2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", "quality", 5, 0)


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = lang_id.fit(docs.where(~held_out))
    return (lang_id.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred",
                    F.col("lang_score").alias("score")))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are of the base spans; ``spans`` and ``n_more`` have the added ones too."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(pii.listing(base), 256).alias("base_sha256"),
                        pii.listing(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_more"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's crc32 3 divides are checked as if their texts had been lower-cased."""
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    return merkle.audited(docs, {"text": merkle.lowered(F.col("text"))}, fold(F.col("doc_id"), 3) == 0)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                         table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"),
                             table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_ann": op3_ann,
    "op4_minhash": op4_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_lang_id": op6_lang_id,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_fingerprint": op9_fingerprint,
    "op10_pii": op10_pii,
    "op11_merkle": op11_merkle,
    "op12_decontamination": op12_decontamination,
    "op13_interaction": op13_interaction,
}
ORACLES: dict[str, str] = {
    "op4_minhash": minhash.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op9_fingerprint": fingerprint.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op12_decontamination": decontamination.ORACLE_SQL,
    "op13_interaction": interaction.ORACLE_SQL,
}
