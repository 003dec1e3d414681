"""Incremental refresh of the seven views (ST-6), driven by new bronze rows.

The service recomputes every view from all of bronze once a minute. Here each bronze
micro-batch recomputes only the UTC days it can change and overwrites those ``day`` partitions
(dynamic partition overwrite). What a day needs beyond its own rows comes from three index
tables, which each micro-batch extends by its own rows:

* ``session_days`` - (shop, session, day): the day's best claim to be the session's geo, and whether the
  session ordered on that day; dealt out by a hash of the session;
* ``order_days``   - (shop, order, type, day), dealt out by a hash of the order;
* ``order_lines``  - purchases and cancels by (shop, tenant, product, order, type, day), one folder a day.

They are logged tables whose compaction adds rows up. A micro-batch appends to them once, however often
it runs, and compares with the index as it was before.

Days a micro-batch changes:

1. the days of its own rows;
2. days of cancels whose order gets its first purchase (an orphan cancel becomes a counted one);
3. all days of sessions whose canonical geo changes;
4. as the lookback's lower bound moves on: the day it cuts, and the days of sessions that lose rows by it.

So bronze itself is read for these days only. ``top_products`` is computed from ``order_lines`` of its
window; of the day that the window's bound cuts, the rows are read from bronze.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BROWSE_TYPES
from ..plans import views as V
from ..sources import storage
from ..sources.table_log import TableLog, Version

DAY_VIEWS = ("daily_traffic", "daily_orders", "daily_funnel", "daily_channel_attribution",
             "daily_geo", "dashboard_kpi")

BUCKETS = 32
ORDER_TYPES = ("purchase", "order_cancel")
SESSION_DAYS = ("shop_id string, session_id string, day date, m struct<no_geo:boolean,created_at:timestamp,id:string,"
                "geo_country:string,geo_subject:string,geo_city:string>, orders boolean, bucket int")
ORDER_DAYS = "shop_id string, order_id string, event_type string, day date, bucket int"
ORDER_LINES = ("shop_id string, tenant_id string, product_id string, order_id string, event_type string, "
               "product_name string, product_price_cents bigint, day date")
SESSION, ORDER = ["shop_id", "session_id"], ["shop_id", "order_id"]


def _day() -> Column:
    return F.to_date("created_at").alias("day")


def _bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("bucket")


def session_days(events: DataFrame) -> DataFrame:
    """``events`` as rows of the session index."""
    each = events.select(*SESSION, _day(), F.when(F.col("event_type").isin(*BROWSE_TYPES), V.geo_rank()).alias("m"),
                         F.col("event_type").isin(*ORDER_TYPES).alias("orders"), _bucket(SESSION))
    return _merged_sessions(each)


def _merged_sessions(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SESSION, "day", "bucket").agg(F.min("m").alias("m"), F.max("orders").alias("orders"))


def order_days(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(*ORDER_TYPES) & F.col("order_id").isNotNull()) \
        .select(*ORDER, "event_type", _day(), _bucket(ORDER)).distinct()


def order_lines(events: DataFrame) -> DataFrame:
    return _merged_lines(events.filter(F.col("event_type").isin(*ORDER_TYPES)).select(
        "shop_id", "tenant_id", "product_id", "order_id", "event_type", _day(), "product_name", "product_price_cents"))


def _merged_lines(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shop_id", "tenant_id", "product_id", "order_id", "event_type", "day").agg(
        F.max("product_name").alias("product_name"), F.sum("product_price_cents").alias("product_price_cents"))


def together(jobs: list) -> None:
    """Run independent jobs side by side: each is small next to the cluster."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(lambda job: job(), jobs))


class Indexes:
    """The index tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        base = f"{root.rstrip('/')}/_index"
        self.sessions = TableLog(spark, f"{base}/session_days", SESSION_DAYS, "bucket", tuple(SESSION), _merged_sessions)
        self.orders = TableLog(spark, f"{base}/order_days", ORDER_DAYS, "bucket", tuple(ORDER), lambda d: d.distinct())
        self.lines = TableLog(spark, f"{base}/order_lines", ORDER_LINES, "day", ("shop_id",), _merged_lines)

    def add(self, events: DataFrame, writer: str, number: int, note: dict) -> None:
        together([lambda: self.orders.append(order_days(events), writer, number),
                  lambda: self.lines.append(order_lines(events), writer, number),
                  lambda: self.sessions.append(session_days(events), writer, number, note)])

    def compact(self) -> None:
        together([table.compact for table in (self.sessions, self.orders, self.lines)])


def _before(table: TableLog, writer: str, number: int) -> Version:
    """The version that the micro-batch ``number`` found when it first ran."""
    v = table.latest()
    while v.writers.get(writer, -1) >= number:
        v = table.version(v.number - 1)
    return v


def _bound(spark: SparkSession, as_of, lookback: str | None) -> dt.datetime | None:
    """The lookback's lower bound, in UTC."""
    bound = V.lower_bound(as_of, lookback)
    return None if bound is None else _instant(spark.range(1), bound)


def _instant(rows: DataFrame, t: Column) -> dt.datetime | None:
    """The one value of an aggregate or constant, in UTC whatever the driver's zone."""
    text = rows.agg(F.max(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"))).first()[0]
    return dt.datetime.fromisoformat(text) if text else None


def _ts(t: dt.datetime) -> Column:
    return F.to_timestamp(F.lit(str(t)))


def _months(days: list[dt.date]) -> list[dt.date]:
    return sorted({d.replace(day=1) for d in days})


def slice_days(bronze: DataFrame, days: list[dt.date]) -> DataFrame:
    """Bronze rows of ``days``; the list is bounded by the lookback (about 400), so it enters the plan as
    literals: month folders are pruned, and the days' range reaches the Parquet reader."""
    if not days:
        return bronze.limit(0)
    lo, hi = (F.to_timestamp(F.lit(str(d))) for d in (min(days), max(days) + dt.timedelta(days=1)))
    return bronze.filter(F.col("event_month").isin(*_months(days)) & (F.col("created_at") >= lo) & (F.col("created_at") < hi)
                         & F.to_date("created_at").isin(*days))


def _day_since(bronze: DataFrame, bound: dt.datetime) -> DataFrame:
    """Bronze rows of the day that ``bound`` cuts, from ``bound`` on."""
    return slice_days(bronze, [bound.date()]).filter(F.col("created_at") >= _ts(bound))


def _in_window(index: DataFrame, bronze: DataFrame, bound: dt.datetime | None) -> DataFrame:
    """Session index rows as of the lookback's lower bound: those of the day that it cuts are made anew."""
    if bound is None:
        return index
    return index.filter(F.col("day") > F.lit(bound.date())).unionByName(session_days(_day_since(bronze, bound)))


def _geo(rows: DataFrame) -> DataFrame:
    geo = F.struct(*[F.col("m")[g].alias(g) for g in V.GEO])
    return rows.groupBy(*SESSION).agg(F.min("m").alias("m")).select(*SESSION, F.when(F.col("m").isNotNull(), geo).alias("geo"))


def affected_days(batch: DataFrame, bronze: DataFrame, sessions: DataFrame, orders: DataFrame,
                  bound: dt.datetime | None = None, old_bound: dt.datetime | None = None) -> DataFrame:
    """Days (``day``) that ``batch`` and the move of the bound can change, by the index rows as they were before."""
    bought = batch.filter((F.col("event_type") == "purchase") & F.col("order_id").isNotNull()).select(*ORDER).distinct()
    known = orders.join(bought, ORDER, "left_semi")
    first = bought.join(known.filter(F.col("event_type") == "purchase").select(*ORDER).distinct(), ORDER, "left_anti")
    late = known.filter(F.col("event_type") == "order_cancel").join(first, ORDER, "left_semi").select("day")
    new = session_days(batch if bound is None else batch.filter(F.col("created_at") >= _ts(bound)))
    old = _in_window(sessions, bronze, bound).join(new.select(*SESSION).distinct(), SESSION, "left_semi")
    was, now = _geo(old), _geo(old.unionByName(new)).withColumnRenamed("geo", "new_geo")
    moved = was.join(now, SESSION).filter(~F.col("geo").eqNullSafe(F.col("new_geo"))).select(*SESSION)
    out = batch.select(_day()).unionByName(late)
    if bound is not None:
        # of the day that the bound cuts, bronze has the batch's rows too, so nothing tells how the geo was
        moved = moved.unionByName(new.filter(F.col("day") == F.lit(bound.date())).select(*SESSION))
    if bound is not None and old_bound is not None and bound > old_bound:
        cut = sessions.filter(F.col("day").between(F.lit(old_bound.date()), F.lit(bound.date())))
        moved = moved.unionByName(cut.select(*SESSION))
        out = out.unionByName(batch.sparkSession.range(1).select(F.lit(bound.date()).alias("day")))
    out = out.unionByName(sessions.join(moved.distinct(), SESSION, "left_semi").select("day"))
    return (out if bound is None else out.filter(F.col("day") >= F.lit(bound.date()))).distinct()


def inputs_of_days(bronze: DataFrame, days: list[dt.date], as_of, sessions: DataFrame, bought: DataFrame,
                   lookback: str | None = V.DAILY_LOOKBACK) -> dict[str, DataFrame]:
    """What the views of ``days`` are made of: ``activity`` and ``orders`` (see views) and ``sessions``. ``sessions``: rows
    of the session index within the lookback; ``bought``: all (shop_id, order_id) with a purchase."""
    on_days = slice_days(bronze, days)
    active = sessions.filter(F.col("day").isin(*days)).select(*SESSION).distinct()
    sd = sessions.join(active, SESSION, "left_semi").groupBy(*SESSION).agg(
        F.min("m").alias("m"), F.collect_set(F.when(F.col("m").isNotNull() & F.col("day").isin(*days), F.col("day"))).alias("days"))
    return {"activity": V.activity_grain(on_days, as_of, lookback),
            "orders": V.deduped_orders(on_days, as_of, lookback, bought=bought),
            "sessions": sd.filter(F.col("m").isNotNull())}


def views_of_days(inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    activity, orders = inputs["activity"], inputs["orders"]
    return {"daily_traffic": V.traffic_from_grain(activity), "daily_orders": V.orders_from_dedup(orders),
            "daily_funnel": V.funnel_from_grain(activity), "daily_channel_attribution": V.channels_from_grain(activity),
            "daily_geo": V.geo_of_sessions(inputs["sessions"], V.without_tenant(orders))}


def write_days(views: dict[str, DataFrame], root: str, days: list[dt.date]) -> None:
    """Overwrite the partitions of ``days``; one that has no rows any more goes."""
    def write(name: str, df: DataFrame) -> None:
        path, begun = f"{root.rstrip('/')}/{name}", time.time()
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        for folder, changed, _ in storage.entries(df.sparkSession, path):
            if folder in {f"day={d}" for d in days} and changed / 1000 < begun - 1:
                storage.delete(df.sparkSession, f"{path}/{folder}")

    together([lambda name=name, df=df: write(name, df) for name, df in views.items()])


def recompute(inputs: dict[str, DataFrame], root: str, days: list[dt.date]) -> None:
    """Write the inputs once, then the views of ``days`` from them, then the KPIs from the views."""
    spark, work = inputs["orders"].sparkSession, f"{root.rstrip('/')}/_work/{uuid.uuid4().hex}"
    together([lambda name=name, df=df: df.write.parquet(f"{work}/{name}") for name, df in inputs.items()])
    views = views_of_days({name: spark.read.schema(df.schema).parquet(f"{work}/{name}") for name, df in inputs.items()})
    write_days(views, root, days)
    stored = {name: spark.read.schema(views[name].schema).parquet(f"{root.rstrip('/')}/{name}").filter(F.col("day").isin(*days))
              for name in ("daily_traffic", "daily_orders")}
    write_days({"dashboard_kpi": V.dashboard_kpi(stored["daily_traffic"], stored["daily_orders"])}, root, days)
    storage.delete(spark, work)


def _drop_days(spark: SparkSession, root: str, before: dt.date) -> None:
    for name in DAY_VIEWS:
        path = f"{root.rstrip('/')}/{name}"
        for folder in storage.folders(spark, path):
            if folder.startswith("day=") and folder < f"day={before}":
                storage.delete(spark, f"{path}/{folder}")


def top_products(bronze: DataFrame, lines: DataFrame, as_of, lookback: str | None = V.TOP_PRODUCTS_LOOKBACK) -> DataFrame:
    """``top_products`` from the order lines of whole days, and from bronze for the day that the window cuts."""
    bound = _bound(bronze.sparkSession, as_of, lookback)
    # a line stands for events of its day; which of them doesn't matter, as all are in the window
    events = lines.withColumn("created_at", F.col("day").cast("timestamp")).drop("day")
    if bound is not None:
        cut = _day_since(bronze, bound).filter(F.col("event_type").isin(*ORDER_TYPES))
        events = events.filter(F.to_date("created_at") > F.lit(bound.date())).unionByName(
            cut.select(*events.columns).withColumn("product_price_cents", F.col("product_price_cents").cast("long")))
    return V.top_products(events, as_of, lookback)


def _write_top(top: DataFrame, root: str, number: int, keep: int = 3) -> None:
    """A new folder for each micro-batch; readers take the last whole one."""
    base, spark = f"{root.rstrip('/')}/top_products", top.sparkSession
    top.write.mode("overwrite").parquet(f"{base}/batch={number:012d}")
    for folder in storage.folders(spark, base)[:-keep]:
        storage.delete(spark, f"{base}/{folder}")


def read_view(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the seven views as the last micro-batch left it."""
    path = f"{root.rstrip('/')}/{name}"
    if name != "top_products":
        return spark.read.parquet(path)
    whole = [f for f in storage.folders(spark, path) if any(n == "_SUCCESS" for n, _, _ in storage.entries(spark, f"{path}/{f}"))]
    return spark.read.parquet(f"{path}/{whole[-1]}")


def refresh_batch(spark: SparkSession, batch: DataFrame, bronze: DataFrame, root: str, as_of,
                  lookback: str | None = V.DAILY_LOOKBACK, writer: str = "refresh", number: int = 0,
                  top_lookback: str | None = V.TOP_PRODUCTS_LOOKBACK) -> list[dt.date]:
    """Bring the views to what a bronze micro-batch makes of them; returns the days recomputed.

    ``as_of`` never goes back: the latest of this and earlier micro-batches counts."""
    index = Indexes(spark, root)
    before, orders = _before(index.sessions, writer, number), _before(index.orders, writer, number)
    last = before.note.get("as_of")
    as_of = str(as_of) if last is None else max(str(as_of), last)
    bound = _bound(spark, as_of, lookback)
    index.add(batch, writer, number, {"as_of": as_of})
    found = affected_days(batch, bronze, index.sessions.frame(before.folders), index.orders.frame(orders.folders), bound,
                          None if last is None else _bound(spark, last, lookback))
    days = sorted(r["day"] for r in found.collect())  # bounded by the lookback
    if days:
        sessions = _in_window(index.sessions.read(), bronze, bound)
        bought = index.orders.read().filter(F.col("event_type") == "purchase")
        recompute(inputs_of_days(bronze, days, as_of, sessions, bought, lookback), root, days)
    if bound is not None:
        _drop_days(spark, root, bound.date())
    _write_top(top_products(bronze, index.lines.read(), as_of, top_lookback), root, number)
    index.compact()
    return days


def start_incremental_refresh(spark: SparkSession, bronze_path: str, root: str, checkpoint: str, as_of=None,
                              trigger: str | None = "1 minute", max_files_per_trigger: int = 100,
                              lookback: str | None = V.DAILY_LOOKBACK, top_lookback: str | None = V.TOP_PRODUCTS_LOOKBACK):
    """Stream a bronze folder into the views; ``trigger=None`` processes what is there and stops.

    Without ``as_of`` each micro-batch counts its lookback from its own last event, so the window
    moves with the data. A day is recomputed from all of bronze as it is then; rows that arrived
    after the micro-batch are in it already and come again with their own."""
    from ..sources.bronze import BRONZE_SCHEMA, read

    stream = spark.readStream.schema(BRONZE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger) \
        .parquet(bronze_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = as_of or _instant(batch, F.col("created_at"))
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if now is not None:
            refresh_batch(batch.sparkSession, batch, read(batch.sparkSession, bronze_path), root, now, lookback, query, batch_id,
                          top_lookback)

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{checkpoint}/incremental")
    w = w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)
    return w.queryName("shoplens_incremental").start()


def refresh_logged(spark: SparkSession, bronze_path: str, root: str, as_of=None, lookback: str | None = V.DAILY_LOOKBACK,
                   top_lookback: str | None = V.TOP_PRODUCTS_LOOKBACK) -> list[dt.date]:
    """Bring the views to the current version of a logged bronze table: what its appends have brought since the
    last call is one micro-batch. Compactions bring nothing, and bronze is read as of one version.

    A call first notes up to which version it goes, and at the end that it is done; one that was cut
    short is made again with the same rows by the next call."""
    from ..sources import bronze as BR

    table, steps = BR.log(spark, bronze_path), f"{root.rstrip('/')}/_index/steps"

    def noted(kind: str) -> list[int]:
        return [int(storage.read_text(spark, f"{steps}/{kind}/{n}"))
                for n, _, _ in storage.entries(spark, f"{steps}/{kind}") if n.isdigit()]

    done = noted("done")
    number, start = len(done), done[-1] if done else 0
    storage.put_if_absent(spark, f"{steps}/begun/{number:012d}", str(table.latest().number))
    until = noted("begun")[number]
    if until == start:
        storage.delete(spark, f"{steps}/begun/{number:012d}")
        return []
    with table.lease():
        batch = table.frame(table.added_since(start, until))
        now = as_of or _instant(batch, F.col("created_at"))
        days = [] if now is None else refresh_batch(spark, batch, table.read(until), root, now, lookback, "logged", number,
                                                    top_lookback)
    storage.put_if_absent(spark, f"{steps}/done/{number:012d}", str(until))
    table.bookmark("refresh", until)
    return days
