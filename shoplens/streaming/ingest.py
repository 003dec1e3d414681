"""Continuous ingest (ST-1..3): raw envelopes stream -> bronze, rejects and quarantine.

One query parses each envelope once. A micro-batch is first written to a staging folder below
the checkpoint, by outcome, then its three outcomes are copied from there:

* events to bronze, a logged table (``sources/table_log.py``): one commit a micro-batch, which is made
  once however often the micro-batch runs, and small folders are merged as they pile up;
* rejected batches (dead letters) to ``rejects/batches``, with reason and body;
* events of accepted batches with an amount beyond 32 bits to ``rejects/quarantine``.

The copies to ``rejects`` overwrite the partition of their own micro-batch only (named by the query's id
and the batch's number). So nothing is lost and nothing is doubled. Micro-batches are bounded at the source
(``maxFilesPerTrigger`` / for Kafka ``maxOffsetsPerTrigger``) and triggered every few seconds, like the
service's 1000-rows-or-5-seconds flush.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import bronze_rows, quarantined_rows, rejected_batches, write_parsed
from ..sources import bronze as BR
from ..sources import envelopes as ENV


def _replace(df: DataFrame, path: str, batch: str, *by: str) -> None:
    """Write ``df`` as the partitions of one micro-batch."""
    (df.withColumn("ingest_batch", F.lit(batch)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(*by, "ingest_batch").parquet(path))


def start_bronze_ingest(spark: SparkSession, raw_path: str, networks: DataFrame, bronze_path: str,
                        rejects_path: str, checkpoint: str, trigger: str | None = "5 seconds",
                        max_files_per_trigger: int = 100) -> StreamingQuery:
    """Start the ingest query; ``trigger=None`` processes what is there and stops."""
    raw = ENV.read(spark, raw_path, streaming=True, max_files_per_trigger=max_files_per_trigger)

    def land(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        query = own.sparkContext.getLocalProperty("sql.streaming.queryId")
        made, labels = write_parsed(batch, networks, f"{checkpoint}/staged")
        table = BR.log(own, bronze_path)
        table.append(bronze_rows(made, labels), query, batch_id)
        table.compact()
        _replace(rejected_batches(made), f"{rejects_path}/batches", f"{query}-{batch_id}")
        _replace(quarantined_rows(made, labels), f"{rejects_path}/quarantine", f"{query}-{batch_id}")

    w = raw.writeStream.foreachBatch(land).option("checkpointLocation", f"{checkpoint}/ingest") \
        .queryName("shoplens_bronze")
    w = w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)
    return w.start()
