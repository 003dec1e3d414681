"""Raw event envelopes (the collect input) as files or a stream.

A raw record is ``(ingest_ts timestamp, remote_addr string, body string)``: the arrival
time, the client address and the request body exactly as received (possibly not JSON).
Files hold one JSON record per line; the same schema is read as a stream.

``envelopes_from_events`` derives envelopes from the ``events`` table: events of one
user within one hour and one block of 100 event ids form a batch (so a batch never has
more than 100 events), with a mix of price encodings, client address shapes and a few
defective batches (cut bodies, empty session ids, unknown types).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bridge import events_bronze_with_source

RAW_SCHEMA = "ingest_ts timestamp, remote_addr string, body string"


def read(spark: SparkSession, path: str, streaming: bool = False,
         max_files_per_trigger: int | None = None) -> DataFrame:
    if streaming:
        r = spark.readStream.schema(RAW_SCHEMA)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.json(path)
    return spark.read.schema(RAW_SCHEMA).json(path)


def write(raw: DataFrame, path: str, mode: str = "overwrite") -> None:
    raw.write.mode(mode).json(path)


def envelopes_from_events(spark: SparkSession, sf_dir: str, extremes: bool = False) -> DataFrame:
    """``extremes`` gives every 13th and 17th event with an order total one that no integer
    column holds, as a string of 23 digits or as the number 1e30."""
    b = events_bronze_with_source(spark, sf_dir)
    eid, uid = F.col("event_id"), F.col("user_id")
    hour = F.floor(F.unix_seconds("created_at") / 3600)
    cents = F.round(F.col("value") * 100).cast("long")
    k = eid % 5
    # product_price as JSON text: a number (cents) or a string (roubles / decimal text)
    price = (F.when(F.col("product_price_cents").isNull(), F.lit(None))
              .when(k == 0, F.concat(F.lit('"'), (cents / 100).cast("long").cast("string"), F.lit(' ₽"')))
              .when(k == 1, F.concat(F.lit('"'), F.format_number(F.col("value"), 2), F.lit('"')))
              .otherwise(cents.cast("string")))
    ts = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    total = cents.cast("string")
    if extremes:
        total = F.when(eid % 13 == 0, F.lit('"99999999999999999999999"')).when(eid % 17 == 0, F.lit("1e30")).otherwise(total)
    # an event's JSON is made row by row; a group only sorts and joins texts
    ev = F.to_json(F.struct(
        F.col("event_type").alias("type"),
        F.when(eid % 211 == 0, F.lit("")).otherwise(F.col("session_id")).alias("session_id"),
        "visitor_id", "page_url", "referrer", "utm_source", "utm_medium", "utm_campaign",
        "product_id", "product_name",
        F.parse_json(price).alias("product_price"),
        "order_id",
        F.parse_json(F.when(F.col("order_total_cents").isNotNull(), total)).alias("order_total"),
        F.when(eid % 19 == 0, F.lit(None)).otherwise(ts).alias("timestamp"),
        F.when(eid % 2 == 0, F.col("shop_id")).otherwise(F.lit("")).alias("shop_id"),
    ))
    b = b.select(F.col("shop_id").alias("env_shop"), F.col("tenant_id").alias("env_tenant"), uid.alias("uid"),
                 hour.alias("hour"), (eid / 100).cast("long").alias("block"), "created_at", F.struct(eid.alias("pos"), ev.alias("json")).alias("ev"))
    g = b.groupBy("env_shop", "env_tenant", "uid", "hour", "block").agg(
        F.array_sort(F.collect_list("ev")).alias("evs"), F.max("created_at").alias("ingest_ts"))
    head = F.to_json(F.struct(F.col("env_shop").alias("shop_id"), F.col("env_tenant").alias("tenant_id")))
    body = F.concat(F.regexp_replace(head, r"\}$", F.when(head == "{}", "").otherwise(",")), F.lit('"events":['),
                    F.array_join("evs.json", ","), F.lit("]}"))
    broken = (F.col("uid") + F.col("hour")) % 97 == 0
    body = F.when(broken, F.substring(body, 1, 40)).otherwise(body)
    a = F.col("uid") % 6
    n = (F.col("uid") % 25).cast("string")
    addr = (F.when(a == 0, F.concat(F.lit("10."), n, F.lit("."), (F.col("hour") % 256).cast("string"),
                                    F.lit(".7:51234")))
             .when(a == 1, F.concat(F.lit(" 10."), n, F.lit(".1.1 ")))
             .when(a == 2, F.concat(F.lit("[2001:db8:"), F.lower(F.hex(F.col("uid") % 25)), F.lit("::1]:443")))
             .when(a == 3, F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("uid") % 25)), F.lit(":0:0:0:0:abcd")))
             .when(a == 4, F.lit("fe80::c0:de%lan3"))
             .otherwise(F.lit("unknown host")))
    return g.select("ingest_ts", addr.alias("remote_addr"), body.alias("body"))


def read_kafka(spark: SparkSession, bootstrap_servers: str, topic: str,
               max_offsets_per_trigger: int | None = 100_000, streaming: bool = True) -> DataFrame:
    """Envelopes from a Kafka topic, mapped to the raw schema: the record value is the
    body, the broker timestamp the ingest time and a ``remote_addr`` header the client
    address. Needs the ``spark-sql-kafka`` package on the classpath (not bundled here);
    offsets are tracked by the streaming checkpoint, so a restart neither loses nor
    repeats records."""
    r = spark.readStream if streaming else spark.read
    r = (r.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
          .option("subscribe", topic).option("includeHeaders", "true"))
    if streaming and max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return kafka_records_to_raw(r.load())


def kafka_records_to_raw(k: DataFrame) -> DataFrame:
    """Kafka records (value binary, timestamp, headers array<struct<key, value binary>>)
    -> the raw envelope schema."""
    addr = F.filter(F.col("headers"), lambda h: h["key"] == "remote_addr")
    return k.select(F.col("timestamp").alias("ingest_ts"),
                    F.try_element_at(addr, F.lit(1))["value"].cast("string").alias("remote_addr"),
                    F.col("value").cast("string").alias("body"))
