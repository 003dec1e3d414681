"""Fold a pixel change feed into the current registry.

Rules (after the service's handlers and table constraints):

* create: shop_id, tenant_id, pixel_type, pixel_id required, pixel_type in the allow-list; an id
  stands for one request, its first valid create;
* (shop_id, pixel_type, pixel_id) is unique among live pixels **at every moment**: a create that
  would break this is refused (the id never comes to exist), and so is an update that
  would, with all its columns. What a refused operation wanted is not made up for later;
* update / delete match on the id and the pixel's own tenant, else they change nothing; a delete
  frees the pixel_id for others;
* update is partial: columns that are null keep their values.

Only ids that ever ask for a pixel_id which another id of their (shop_id, pixel_type) asks for too can be
refused. All others are folded by a hash aggregation on the id, however large a shop's feed is. What the
contested ids do is dealt out by (shop_id, pixel_type), sorted by ``seq`` and replayed batch by batch, in
constant work an operation; a task holds the contested live pixels of one scope, not its feed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PIXEL_TYPES

REGISTRY_COLS = ["id", "shop_id", "tenant_id", "pixel_type", "pixel_id", "name", "is_active",
                 "created_at", "updated_at"]
REGISTRY_SCHEMA = ("id string, shop_id string, tenant_id string, pixel_type string, pixel_id string, name string, "
                   "is_active boolean, created_at timestamp, updated_at timestamp")


def _nonempty(c: str):
    return F.col(c).isNotNull() & (F.col(c) != "")


def _apply(live: dict[str, dict], holder: dict[str, str], op: dict) -> None:
    """One operation on the live pixels (by id) of its scope; ``holder`` has the id of each live pixel_id."""
    own = live.get(op["id"])
    if op["op"] == "delete":
        if own:
            del live[op["id"]], holder[own["pixel_id"]]
        return
    if holder.get(op["pixel_id"], op["id"]) != op["id"]:
        return
    if op["op"] == "create":
        live[op["id"]] = {c: op[c] for c in REGISTRY_COLS[:6]} | {
            "is_active": True, "created_at": op["ts"], "updated_at": op["ts"]}
        holder[op["pixel_id"]] = op["id"]
    elif own:
        if op["pixel_id"] is not None:
            del holder[own["pixel_id"]]
            holder[op["pixel_id"]] = op["id"]
        own.update({c: op[c] for c in ("pixel_id", "name", "is_active") if op[c] is not None})
        own["updated_at"] = max(own["updated_at"], op["ts"])


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scope, live, holder = None, {}, {}
    for batch in batches:
        done: list[dict] = []
        for op in batch.astype(object).where(batch.notna(), None).to_dict("records"):
            if (op["shop_id"], op["pixel_type"]) != scope:
                done += live.values()
                scope, live, holder = (op["shop_id"], op["pixel_type"]), {}, {}
            _apply(live, holder, op)
        yield pd.DataFrame(done, columns=REGISTRY_COLS)
    yield pd.DataFrame(list(live.values()), columns=REGISTRY_COLS)


def _folded(ops: DataFrame) -> DataFrame:
    """The registry rows of ids that are never refused."""
    created, update = F.col("op") == "create", F.col("op") == "update"

    def last(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)

    # an id has one create, its first operation; after a delete it never lives again
    alive = ops.groupBy("id", "shop_id", "tenant_id", "pixel_type").agg(
        last("pixel_id"), last("name"), F.max_by("is_active", F.when(update & F.col("is_active").isNotNull(), F.col("seq"))).alias("on"),
        F.max(F.when(created, F.col("ts"))).alias("created_at"), F.max(F.when(created | update, F.col("ts"))).alias("updated_at"),
        F.max(F.col("op") == "delete").alias("gone")).filter(~F.col("gone"))
    return alive.withColumn("is_active", F.coalesce("on", F.lit(True))).select(*REGISTRY_COLS)


def fold(feed: DataFrame) -> DataFrame:
    valid_create = ((F.col("op") == "create") & _nonempty("shop_id") & _nonempty("tenant_id")
                    & _nonempty("pixel_type") & _nonempty("pixel_id") & F.col("pixel_type").isin(*PIXEL_TYPES))
    born = (feed.filter(valid_create).groupBy("id")
            .agg(F.min_by(F.struct("seq", "shop_id", "tenant_id", "pixel_type"), "seq").alias("b"))
            .select("id", F.col("b.seq").alias("_born"), F.col("b.shop_id").alias("_shop"),
                    F.col("b.tenant_id").alias("_tenant"), F.col("b.pixel_type").alias("_type")))
    later = F.col("op").isin("update", "delete") & (F.col("seq") > F.col("_born")) & (F.col("tenant_id") == F.col("_tenant"))
    ops = feed.join(born, "id").filter(later | (F.col("seq") == F.col("_born"))).select(
        "seq", "op", "id", F.col("_shop").alias("shop_id"), "tenant_id", F.col("_type").alias("pixel_type"),
        "pixel_id", "name", "is_active", "ts")
    scope = ["shop_id", "pixel_type"]
    asked = ops.filter((F.col("op") != "delete") & F.col("pixel_id").isNotNull()).select(*scope, "pixel_id", "id").distinct()
    shared = asked.groupBy(*scope, "pixel_id").agg(F.count(F.lit(1)).alias("ids")).filter("ids > 1")
    contested = asked.join(shared, [*scope, "pixel_id"], "left_semi").select("id").distinct()
    replayed = ops.join(contested, "id", "left_semi").repartition(*scope).sortWithinPartitions(*scope, "seq") \
        .mapInPandas(_replay, REGISTRY_SCHEMA)
    return _folded(ops.join(contested, "id", "left_anti")).unionByName(replayed)


def list_pixels(registry: DataFrame, shop_id: str | None = None, tenant_id: str | None = None) -> DataFrame:
    """Pixels of each (shop, tenant), newest first (``position`` 1 = newest); NULL name -> ''."""
    r = registry
    if shop_id is not None:
        r = r.filter(F.col("shop_id") == shop_id)
    if tenant_id is not None:
        r = r.filter(F.col("tenant_id") == tenant_id)
    w = Window.partitionBy("shop_id", "tenant_id").orderBy(F.col("created_at").desc(), F.col("id"))
    return r.select("shop_id", "tenant_id", "id", "pixel_type", "pixel_id",
                    F.coalesce("name", F.lit("")).alias("name"), "is_active", "created_at",
                    F.row_number().over(w).cast("long").alias("position"))


def active_pixels(registry: DataFrame, shop_id: str | None = None) -> DataFrame:
    """Active pixels of each shop, oldest first (what the public loader reads)."""
    r = registry.filter(F.col("is_active"))
    if shop_id is not None:
        r = r.filter(F.col("shop_id") == shop_id)
    w = Window.partitionBy("shop_id").orderBy(F.col("created_at"), F.col("id"))
    return r.select("shop_id", "pixel_type", "pixel_id", F.row_number().over(w).cast("long").alias("position"))
