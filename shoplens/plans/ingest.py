"""Ingest: raw envelopes -> validated, enriched bronze rows (+ rejected batches).

1. parse the body once (``try_parse_json`` -> VARIANT; a body over 1 MiB counts as cut,
   i.e. invalid JSON);
2. decide per batch, **without a shuffle**: the type checks and the per-event rules are
   array expressions over the batch's own events, and the batch reason is the first
   failing event by position (all-or-nothing);
3. explode accepted batches (position kept), inherit shop/tenant from the envelope,
   convert prices, store '' and 0 as NULL, default a missing timestamp to the ingest
   time. All of a batch's events are read from the parsed body by one typed extraction;
4. what came of it is written (``parsed``: one scan and one parse of the raw input, no exchange);
5. the distinct client addresses of accepted batches are looked up in the network table and the
   labels joined to the stored events. Bodies of rejected batches have no part in that; the address
   is dropped with the written intermediate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_BODY_BYTES, MAX_EVENTS_PER_BATCH
from ..functions.ip import with_client_ip
from ..functions.price import price_variant_to_cents
from ..functions.text import in_int32, nullify_empty, nullify_zero
from ..operators.range_join import geo_labels, with_labels
from ..operators.validate import default_timestamp, event_reason
from ..session import checkpoint_root
from ..sources.bridge import BRONZE_COLUMNS

GEO = ("geo_country", "geo_subject", "geo_city")
TEXT_FIELDS = ("type", "session_id", "visitor_id", "page_url", "page_title", "referrer", "utm_source",
               "utm_medium", "utm_campaign", "product_id", "product_name", "order_id", "timestamp",
               "category_id", "geo_country", "geo_subject", "geo_city", "shop_id", "tenant_id")


#: a batch's events as they are read: text fields, and three that may hold any JSON value
EVENTS_TYPE = "array<struct<" + ", ".join(f"{c}: string" for c in TEXT_FIELDS) + \
    ", product_price: variant, order_total: variant, cost_price_cents: variant>>"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_text(v: Column) -> Column:
    return v.isNull() | _kind(v).isin("STRING", "VOID")


def _is_whole(v: Column) -> Column:
    """A JSON integer literal (or null): a decimal point or exponent ('1.0', '1e2') or a
    value beyond 64 bits does not decode into an integer field."""
    return v.isNull() | _kind(v).isin("VOID", "BIGINT", "INT", "SMALLINT", "TINYINT")


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _once(c: Column) -> Column:
    """``c``, which the optimizer neither inlines where it is used nor pushes filters through: it does
    so with nothing that isn't deterministic, as the (always true) condition on the partition's id."""
    return F.when(F.spark_partition_id() >= 0, c)


def _types_ok(m: Column) -> Column:
    """Typed decoding rule of an object, as ``map<string, variant>`` (null: it is none): known text
    fields must be JSON strings (or null); an integer field must be a whole number. ``isin`` looks the
    name up in a hash set."""
    text_ok = F.forall(F.map_entries(m), lambda x: ~x["key"].isin(*TEXT_FIELDS)
                       | F.schema_of_variant(x["value"]).isin("STRING", "VOID"))
    return m.isNotNull() & text_ok & _is_whole(F.try_element_at(m, F.lit("cost_price_cents")))


def parse_batches(raw: DataFrame) -> DataFrame:
    """One row per raw envelope with ``batch_id``, ``v`` (parsed body), ``events``
    (array<variant>), ``rows`` (the same, typed), ``env_shop`` and ``env_tenant`` (the body's own) and
    ``reason`` (NULL = accepted).

    Whether the body is an object and its events are an array of objects is told by extracting them
    as such (null if they are not): the schema of a body would have to be made of all of its events.
    The body is parsed and each extraction made once a batch; without ``_once``, a filter on ``reason``
    would be pushed below all of them, with a copy of each in every place that it is used."""
    batch_id = F.sha2(F.concat_ws("|", F.col("ingest_ts").cast("string"), F.coalesce("remote_addr", F.lit("")),
                                  F.coalesce("body", F.lit(""))), 256)
    # the body is read up to the byte limit; a longer body is cut there (and a cut
    # document no longer parses, unless only trailing blanks were cut)
    body = F.when(F.octet_length("body") > MAX_BODY_BYTES,
                  F.decode(F.substring(F.encode("body", "UTF-8"), 1, MAX_BODY_BYTES), "UTF-8")
                  ).otherwise(F.col("body"))
    d = raw.select("*", batch_id.alias("batch_id"), _once(F.try_parse_json(body)).alias("v"))
    top, maps = F.col("_top"), F.col("_maps")
    # _top: the body's own fields, null if it is no object
    # rows: all events in one extraction; null if a field's type is wrong, which rejects the batch anyway
    d = d.select("*", _once(F.try_variant_get("v", "$", "struct<shop_id: variant, tenant_id: variant>")).alias("_top"),
                 _once(F.try_variant_get("v", "$.events", "array<variant>")).alias("events"),
                 _once(F.try_variant_get("v", "$.events", "array<map<string,variant>>")).alias("_maps"),
                 _once(F.try_variant_get("v", "$.events", EVENTS_TYPE)).alias("rows"),
                 _once(_text(F.col("v"), "shop_id")).alias("env_shop"),
                 _once(nullify_empty(_text(F.col("v"), "tenant_id"))).alias("env_tenant"))
    types_ok = (_is_text(top["shop_id"]) & _is_text(top["tenant_id"])
                & (maps.isNotNull() | F.try_variant_get("v", "$.events", "variant").isNull())
                & F.coalesce(F.forall(maps, _types_ok), F.lit(True)))
    shop = F.col("env_shop")
    n = F.coalesce(F.size(maps), F.lit(0))
    first_bad = F.try_element_at(F.filter(
        F.transform("rows", lambda e: event_reason(e["session_id"], e["type"], e["timestamp"], F.col("ingest_ts"))),
        lambda r: r.isNotNull()), F.lit(1))
    reason = (F.when(top.isNull() | ~types_ok, F.lit("invalid_json"))
               .when(shop.isNull() | (shop == ""), F.lit("shop_id_required"))
               .when((n < 1) | (n > MAX_EVENTS_PER_BATCH), F.lit("events_count"))
               .otherwise(first_bad))
    return d.withColumn("reason", _once(reason)).drop("_top", "_maps")


MONEY = ("product_price_cents", "order_total_cents", "cost_price_cents")


def _bronze_events(client_geo: bool = False) -> Column:
    """array<struct> of the bronze rows of a batch's events, money still 64 bits wide, without geo or with
    what the client sent.

    All columns of an event are built inside one ``transform``: the lambda is evaluated per
    element outside the generated code, which keeps the stage's generated method small (a
    flat projection of ~25 extractions exceeds the JVM method size limit)."""
    def one(e: Column, i: Column) -> Column:
        def opt(name: str) -> Column:
            return nullify_empty(e[name])

        return F.struct(
            F.concat_ws("-", F.col("batch_id"), i.cast("string")).alias("id"),
            F.coalesce(opt("shop_id"), F.col("env_shop")).alias("shop_id"),
            F.coalesce(opt("tenant_id"), F.col("env_tenant")).alias("tenant_id"),
            e["session_id"].alias("session_id"),
            opt("visitor_id").alias("visitor_id"),
            e["type"].alias("event_type"),
            *[opt(c).alias(c) for c in ("page_url", "page_title", "referrer", "utm_source", "utm_medium",
                                        "utm_campaign", "product_id", "product_name")],
            nullify_zero(price_variant_to_cents(e["product_price"])).alias("product_price_cents"),
            opt("order_id").alias("order_id"),
            nullify_zero(price_variant_to_cents(e["order_total"])).alias("order_total_cents"),
            default_timestamp(e["timestamp"], F.col("ingest_ts")).alias("event_timestamp"),
            F.col("ingest_ts").alias("created_at"),
            F.variant_get(e["cost_price_cents"], "$", "bigint").alias("cost_price_cents"),
            e["category_id"].alias("category_id"),
            *([opt(g).alias(f"client_{g}") for g in GEO] if client_geo else []))

    return F.transform("rows", one)


def _with_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_month", F.trunc(F.to_date("created_at"), "MM"))


def flatten(accepted: DataFrame) -> DataFrame:
    """Accepted batches -> one row per event, not located (array position kept in ``id``)."""
    return _with_month(accepted.select(F.inline(_bronze_events())))


def _fits() -> Column:
    ok = F.lit(True)
    for c in MONEY:
        ok = ok & in_int32(c)
    return ok


def parsed(raw: DataFrame, keep_client_geo: bool = False) -> DataFrame:
    """Everything ingest makes of ``raw`` but the geo, in one scan, one parse a batch and no exchange.

    ``kind`` is ``bronze`` (a stored event), ``quarantine`` (an event of an accepted batch whose
    amount does not fit 32 bits) or ``rejected`` (a batch, with ``reason`` and ``body``). ``ip_hex`` is the
    client address of accepted batches."""
    b = with_client_ip(parse_batches(raw), "remote_addr", "ip_hex")
    fine = F.col("reason").isNull()
    rows = b.select(
        "batch_id", "ingest_ts", "reason", F.when(~fine, F.col("body")).alias("body"),
        F.when(fine, F.col("ip_hex")).alias("ip_hex"), F.inline_outer(F.when(fine, _bronze_events(keep_client_geo))))
    kind = F.when(~fine, F.lit("rejected")).when(_fits(), F.lit("bronze")).otherwise(F.lit("quarantine"))
    return _with_month(rows.withColumn("kind", kind))


def located(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored events of ``parsed`` with their geo, without the address."""
    out = with_labels(events, "ip_hex", labels).drop("ip_hex")
    for g in GEO:
        if f"client_{g}" in out.columns:
            out = out.withColumn(g, F.coalesce(g, f"client_{g}")).drop(f"client_{g}")
    return out


def bronze_rows(made: DataFrame, labels: DataFrame) -> DataFrame:
    good = located(made.filter(F.col("kind") == "bronze"), labels)
    for c in MONEY:
        good = good.withColumn(c, F.col(c).cast("int"))
    return good.select(*BRONZE_COLUMNS)


def rejected_batches(made: DataFrame) -> DataFrame:
    return made.filter(F.col("kind") == "rejected").select("batch_id", "ingest_ts", "reason", "body")


def quarantined_rows(made: DataFrame, labels: DataFrame) -> DataFrame:
    """Events whose amounts do not fit, with these as 64-bit numbers (saturated)."""
    bad = located(made.filter(F.col("kind") == "quarantine"), labels).withColumn("reason", F.lit("amount_out_of_range"))
    return bad.select(*BRONZE_COLUMNS, "reason", "batch_id")


def write_parsed(raw: DataFrame, networks: DataFrame, path: str, keep_client_geo: bool = False
                 ) -> tuple[DataFrame, DataFrame]:
    """Write ``parsed(raw)`` below ``path``, by kind, and the labels of its addresses; both read back."""
    spark = raw.sparkSession
    made = parsed(raw, keep_client_geo)
    made.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("kind").parquet(f"{path}/parsed")
    back = spark.read.schema(made.schema).parquet(f"{path}/parsed")
    labels = geo_labels(back.filter(F.col("kind") != "rejected"), "ip_hex", networks)
    labels.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/labels")
    return back, spark.read.schema(labels.schema).parquet(f"{path}/labels")


def ingest(raw: DataFrame, networks: DataFrame, keep_client_geo: bool = False, path: str | None = None
           ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bronze rows, rejected batches, quarantined rows) of ``raw``, which is read once: the intermediate is
    written below ``path``, by default a new folder in the shared checkpoint folder."""
    path = path or f"{checkpoint_root(raw.sparkSession)}/ingest-{uuid.uuid4().hex}"
    made, labels = write_parsed(raw, networks, path, keep_client_geo)
    return bronze_rows(made, labels), rejected_batches(made), quarantined_rows(made, labels)
