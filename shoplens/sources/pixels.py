"""Tracking-pixel change feed.

The registry of the service is changed by create / partial update / delete calls; here
these calls form a change feed ``(seq, op, id, shop_id, tenant_id, pixel_type, pixel_id,
name, is_active, ts)`` folded by :mod:`shoplens.operators.pixels`.

``feed_from_events`` derives a feed from the ``events`` table (one call per event) so
that the fold runs on data that grows with the input: sign-ups create, views rename,
clicks switch on/off, purchases change the pixel id, every 9th error deletes; every 11th call
carries a foreign tenant and every 13th create an unknown pixel type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import PIXEL_TYPES

FEED_SCHEMA = ("seq long, op string, id string, shop_id string, tenant_id string, pixel_type string, "
               "pixel_id string, name string, is_active boolean, ts timestamp")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEED_SCHEMA).json(path)


def feed_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    op = (F.when(et == "signup", "create").when((et == "error") & (eid % 9 == 0), "delete")
           .when(et.isin("view", "click", "purchase"), "update"))
    types = F.array(*[F.lit(t) for t in PIXEL_TYPES])
    ptype = F.when(eid % 13 == 0, F.lit("bogus")).otherwise(
        F.element_at(types, ((uid + eid) % len(PIXEL_TYPES) + 1).cast("int")))
    is_create = et == "signup"
    return e.select(
        eid.alias("seq"), op.alias("op"),
        F.concat(F.lit("px_"), uid.cast("string"), F.lit("_"), (eid % 3).cast("string")).alias("id"),
        F.concat(F.lit("shop_"), (uid % 5).cast("string")).alias("shop_id"),
        F.when(eid % 11 == 0, F.lit("tenant_x"))
         .otherwise(F.concat(F.lit("tenant_"), ((uid % 5) % 2).cast("string"))).alias("tenant_id"),
        F.when(is_create, ptype).alias("pixel_type"),
        F.when(is_create | (et == "purchase"), F.concat(F.lit("PX-"), (eid % 7).cast("string"))).alias("pixel_id"),
        F.when(is_create & (eid % 4 != 0), F.concat(F.lit("Pixel "), (eid % 10).cast("string")))
         .when(et == "view", F.concat(F.lit("Renamed "), (eid % 10).cast("string"))).alias("name"),
        F.when(et == "click", (eid % 2 == 0)).alias("is_active"),
        F.col("ts").cast("timestamp").alias("ts"),
    ).filter(F.col("op").isNotNull())
