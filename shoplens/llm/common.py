"""Small helpers shared by the operators: tables, staged intermediates, folds, samples."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.session import checkpoint_root

#: rows and bytes of an Arrow batch: a batch of whole texts stays at a few MB
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on (small Arrow batches of long texts)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the cluster's shared folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_root(spark)}/llm/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_struct(df: DataFrame, made: Column, names: tuple[str, ...]) -> DataFrame:
    """``df`` with the fields ``names`` of the struct ``made``; columns of these names are replaced."""
    rest = [c for c in df.columns if c not in names]
    return (df.withColumn("__made", made)
            .select(*rest, *(F.col(f"__made.{n}").alias(n) for n in names)))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more), chosen by a hash of ``key`` and the row.

    The choice depends on the rows and their number only, so reruns agree. Of equal rows one is taken, and
    a key that many rows share counts as these rows, so no key makes the sample larger.
    """
    n = df.count()
    if n <= rows:
        return df
    below = -(1 << 63) + (1 << 64) * rows // n
    h = F.xxhash64(F.lit("sample"), key, *(F.col(f"`{c}`") for c in df.columns))
    return df.withColumn("__sample", h).where(F.col("__sample") < below).dropDuplicates(["__sample"]).drop("__sample")


#: blocks of a membership filter at most (8 MB), each of so many bits; so many bits for each id below that
FILTER_BLOCKS, BLOCK_BITS, BITS_PER_ID = 1 << 11, 1 << 15, 16


def _filter(key: str, ids: DataFrame) -> tuple[DataFrame, Column]:
    """A broadcast bit filter of bounded size, and the condition that joins a row's ``key`` to its block: never
    false for keys that are among ``ids``. An id's bits lie in one block. All of it is Spark's own expressions, so the
    rows' other columns don't pass through Python workers, nor wait for them in the executors' heap."""
    name, n = ids.columns[0], ids.count()
    blocks = min(FILTER_BLOCKS, max(1, 1 << (BITS_PER_ID * n // BLOCK_BITS).bit_length()))

    def block(c: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(0), c), F.lit(blocks))

    def places(c: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(seed), c), F.lit(BLOCK_BITS)) for seed in (1, 2)]

    rows = ids.select(block(F.col(name)).alias("__block"), F.explode(F.array(*places(F.col(name)))).alias("at")) \
        .groupBy("__block").agg(F.bitmap_construct_agg("at").alias("__bits"))

    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.bit_get(byte, (at % 8).cast("int")) == 1

    one, two = places(F.col(key))
    return F.broadcast(rows), (block(F.col(key)) == F.col("__block")) & is_set(one) & is_set(two)


def rows_of(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` (long) is among ``ids`` (one column, distinct values).

    The bit filter drops most other rows before the join shuffles what is left of ``df``; where
    there are too many ids for it, it drops fewer, and the join decides.
    """
    some = df.where(F.col(key).isNotNull()).join(*_filter(key, ids), "left_semi")
    return some.join(ids, F.col(key) == F.col(ids.columns[0]), "left_semi")


def rows_without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` (long) is null or not among ``ids``; what the filter clears
    isn't shuffled."""
    bits, maybe = _filter(key, ids)
    maybe &= F.col(key).isNotNull()
    doubtful = df.join(bits, maybe, "left_semi").join(ids, F.col(key) == F.col(ids.columns[0]), "left_anti")
    return df.join(bits, maybe, "left_anti").unionByName(doubtful)
