"""Listing, reading, writing once and deleting in whatever store a path names (Hadoop's FileSystem, on
the driver)."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it doesn't exist."""
    return [name for name, _, folder in entries(spark, path) if folder]


def entries(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """(name, time of change in ms, whether a folder) of what is in ``path``; none if it doesn't exist."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.getModificationTime(), s.isDirectory()) for s in fs.listStatus(p))


def in_order(spark: SparkSession, path: str) -> int:
    """Give the part files in ``path`` times of change a second apart, in the order of their numbers, the last one
    now: a stream that takes files by these times then takes them in this order. Returns their number."""
    fs, p = _at(spark, path)
    parts = sorted((n for n, _, folder in entries(spark, path) if n.startswith("part-") and not folder),
                   key=lambda n: (int(n.split("-")[1]), n))
    now = int(time.time() * 1000)
    for k, name in enumerate(reversed(parts)):
        fs.setTimes(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, name), now - 1000 * k, -1)
    return len(parts)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with all of ``text``, unless it exists; whether this call created it.

    The text is written beside it first, then put in place by one step that fails if the file is there:
    a link on a local disk, elsewhere the store's rename. That must not replace files, as with HDFS;
    a plain object store gives no such promise.
    """
    fs, p = _at(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p.getParent()}/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(p) and bool(fs.rename(draft, p))
        try:
            os.link(draft.toUri().getPath(), p.toUri().getPath())
            return True
        except FileExistsError:
            return False
    finally:
        fs.delete(draft, False)
