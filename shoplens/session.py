"""Spark session helpers.

The library never builds its own session inside a job; it only makes sure the
settings its semantics depend on (UTC day boundaries) are in place.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every shoplens job relies on. Day boundaries are UTC everywhere.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Sensible defaults for scale: AQE re-plans joins, coalesces small shuffle partitions
# and splits skewed ones at runtime.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

#: bytes of shuffled data that AQE puts together for one task, at most. They are counted as they are compressed, and
#: rows of a few keys take some 4 bytes so: Spark's 64 MB are 16 million rows, which a join sorts in several GB.
TASK_BYTES = 16 << 20
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _bytes(text: str) -> int:
    """A size as Spark writes it, in bytes."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the settings the library depends on to an existing session, and bound what a task reads."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    if _bytes(spark.conf.get(ADVISORY)) > TASK_BYTES:
        spark.conf.set(ADVISORY, str(TASK_BYTES))
    return spark


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "shoplens",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests, the bench and local runs (UI off, UTC, AQE on)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("SHOPLENS_DRIVER_MEMORY", "8g")))
    if os.environ.get("SHOPLENS_CHECKPOINT_DIR"):
        b = b.config("spark.checkpoint.dir", os.environ["SHOPLENS_CHECKPOINT_DIR"])
    for k, v in {**DEFAULT_CONF, **REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_conf(spark)


def is_single_machine(master: str) -> bool:
    """``local``, ``local[*]`` and the like; ``local-cluster`` has executors of its own."""
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Uses ``spark.checkpoint.dir`` as configured by the cluster. Only when it is unset on a
    local master (tests) a fresh local folder is created and registered; on a cluster that
    would be a folder of one machine, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not is_single_machine(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shoplens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")
