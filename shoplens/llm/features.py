"""Labelled samples for the text classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import bounded_sample


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) covers, with ``label``.

    Only the sampled labels are broadcast: their number is bounded by ``rows``. A doc_id that is
    labelled more than once counts with its largest label; null ids, labels and texts teach nothing.
    """
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("doc_id IS NOT NULL") \
        .groupBy("doc_id").agg(F.max("label").alias("label")).where("label IS NOT NULL")
    sample = bounded_sample(known, F.col("doc_id"), rows)
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
