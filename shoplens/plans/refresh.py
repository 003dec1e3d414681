"""Full refresh of the silver and gold views (SNK-2).

Silver views are computed from bronze and written first; gold views read the silver
tables just written (as the database recomputes gold from the silver matviews). Every
refresh writes into a new ``version=<n>`` directory, so readers of the previous version
are never blocked or shown a half-written table. Versions are never reused. ``drop_versions``
removes what no reader needs. An error in one view, or in an intermediate, is recorded for the views
that need it, and the others go on.

A version is audited before readers see it: each written view is read back and must have one row for
each key of its grain (VW-8). Then the version is published: ``_current/<k>``, created only if it is
absent, names the k-th published version, and readers take the last. Of refreshes that run at once
each publishes whole or not at all, and none takes readers back to an earlier ``as_of``.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import parse_instant
from ..sources import storage
from . import views as V

SILVER = ("daily_traffic", "daily_orders", "daily_funnel", "daily_channel_attribution", "daily_geo")
GOLD = ("dashboard_kpi", "top_products")


def _version(as_of) -> str:
    return f"{parse_instant(as_of).strftime('%Y%m%d%H%M%S')}-{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"


def view_path(root: str, name: str, version: str) -> str:
    return f"{root.rstrip('/')}/{name}/version={version}"


def refresh_all(spark: SparkSession, bronze: DataFrame, root: str, as_of,
                lookback: str | None = V.DAILY_LOOKBACK,
                top_lookback: str | None = V.TOP_PRODUCTS_LOOKBACK,
                version: str | None = None, shared: bool = True, parallel: int = 4) -> dict[str, dict]:
    """Recompute all views from ``bronze``, write them under ``root`` and publish them.

    Returns per view: path, seconds, error (None when it succeeded) and outcome: ``published``,
    ``superseded`` (readers have a later ``as_of`` already) or ``refused`` (an error, or a grain that is broken)."""
    version = version or _version(as_of)
    report: dict[str, dict] = {}

    def write(name: str, build) -> None:
        path = view_path(root, name, version)
        t0 = time.perf_counter()
        try:
            build().write.mode("overwrite").parquet(path)
            report[name] = {"path": path, "seconds": round(time.perf_counter() - t0, 3), "error": None}
        except Exception as e:  # noqa: BLE001 - one failing view must not stop the others
            report[name] = {"path": path, "seconds": round(time.perf_counter() - t0, 3),
                            "error": f"{type(e).__name__}: {e}"[:500]}

    def run_all(jobs: dict) -> None:
        # independent jobs are submitted together: each is small next to the cluster, so
        # running them side by side fills the executors instead of idling between stages
        if parallel <= 1 or len(jobs) <= 1:
            for name, build in jobs.items():
                write(name, build)
            return
        with ThreadPoolExecutor(max_workers=min(parallel, len(jobs))) as pool:
            list(pool.map(lambda kv: write(*kv), jobs.items()))

    if shared:
        # one bronze pass for traffic/funnel/channels, one order dedup for orders/geo, the sessions'
        # geo once for its two uses; all written once (this also cuts the lineage the seven views
        # would otherwise repeat)
        work = f"{root.rstrip('/')}/_work/version={version}"
        inter = {"activity": V.activity_grain(bronze, as_of, lookback),
                 "orders": V.deduped_orders(bronze, as_of, lookback),
                 "sessions": V.session_days(bronze, as_of, lookback)}

        def keep(item: tuple[str, DataFrame]) -> tuple[str, Exception | None]:
            try:
                item[1].write.mode("overwrite").parquet(f"{work}/{item[0]}")
                return item[0], None
            except Exception as e:  # noqa: BLE001 - the views without this input go on
                return item[0], e

        with ThreadPoolExecutor(max_workers=max(1, min(3, parallel))) as pool:
            failed = dict(pool.map(keep, inter.items()))

        def stored(name: str) -> DataFrame:
            if failed[name] is not None:
                raise failed[name]
            return spark.read.parquet(f"{work}/{name}")

        silver = {
            "daily_traffic": lambda: V.traffic_from_grain(stored("activity")),
            "daily_orders": lambda: V.orders_from_dedup(stored("orders")),
            "daily_funnel": lambda: V.funnel_from_grain(stored("activity")),
            "daily_channel_attribution": lambda: V.channels_from_grain(stored("activity")),
            "daily_geo": lambda: V.geo_of_sessions(stored("sessions"), V.without_tenant(stored("orders"))),
        }
    else:
        silver = {
            "daily_traffic": lambda: V.daily_traffic(bronze, as_of, lookback),
            "daily_orders": lambda: V.daily_orders(bronze, as_of, lookback),
            "daily_funnel": lambda: V.daily_funnel(bronze, as_of, lookback),
            "daily_channel_attribution": lambda: V.daily_channels(bronze, as_of, lookback),
            "daily_geo": lambda: V.daily_geo(bronze, as_of, lookback),
        }
    silver["top_products"] = lambda: V.top_products(bronze, as_of, top_lookback)
    run_all(silver)
    if shared:
        storage.delete(spark, work)
    if report["daily_traffic"]["error"] is None and report["daily_orders"]["error"] is None:
        t = spark.read.parquet(report["daily_traffic"]["path"])
        o = spark.read.parquet(report["daily_orders"]["path"])
        write("dashboard_kpi", lambda: V.dashboard_kpi(t, o))
    else:
        report["dashboard_kpi"] = {"path": None, "seconds": 0.0, "error": "silver input failed"}
    outcome = "refused"
    if all(v["error"] is None for v in report.values()):
        for name, keys in broken_grains(spark, report).items():
            report[name]["error"] = f"{keys} keys of its grain have several rows"
    if all(v["error"] is None for v in report.values()):
        outcome = "published" if publish(spark, root, version, as_of) else "superseded"
    for v in report.values():
        v["outcome"] = outcome
    return report


def broken_grains(spark: SparkSession, report: dict[str, dict]) -> dict[str, int]:
    """By written view the number of grain keys with several rows, where there are any."""
    found = V.grain_check({name: spark.read.parquet(v["path"]) for name, v in report.items()})
    return {r["view_name"]: r["violations"] for r in found.where("violations > 0").collect()}


def _published(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """The last publication: its number (0: none yet) and what it says."""
    base = f"{root.rstrip('/')}/_current"
    numbers = [int(n) for n, _, folder in storage.entries(spark, base) if n.isdigit() and not folder]
    return (max(numbers), json.loads(storage.read_text(spark, f"{base}/{max(numbers):012d}"))) if numbers else (0, None)


def publish(spark: SparkSession, root: str, version: str, as_of) -> bool:
    """Make ``version`` the one that readers get; False if they have a later ``as_of``."""
    own = parse_instant(as_of).isoformat()
    while True:
        number, last = _published(spark, root)
        if last is not None and last["as_of"] > own:
            return False
        if storage.put_if_absent(spark, f"{root.rstrip('/')}/_current/{number + 1:012d}",
                                 json.dumps({"version": version, "as_of": own})):
            return True


def current_version(spark: SparkSession, root: str) -> str | None:
    """The last published version (None before the first)."""
    last = _published(spark, root)[1]
    return last["version"] if last else None


def drop_versions(spark: SparkSession, root: str, keep: int = 3) -> list[str]:
    """Delete all but the last ``keep`` versions of each view (never the current one); returns the
    deleted folders. Keep as many as the longest read may be behind."""
    current, gone = current_version(spark, root), []
    for name in (*SILVER, *GOLD):
        base = f"{root.rstrip('/')}/{name}"
        old = [v for v in storage.folders(spark, base) if v.startswith("version=")][:-max(1, keep)]
        gone += [f"{base}/{v}" for v in old if v != f"version={current}"]
    for path in gone:
        storage.delete(spark, path)
    return gone


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    v = current_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"no complete refresh under {root}")
    return read_view(spark, root, name, v)


def read_view(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    return spark.read.parquet(view_path(root, name, version))


def refresh_summary(spark: SparkSession, report: dict[str, dict], as_of) -> DataFrame:
    """The refresh report as a small DataFrame (one row per view)."""
    rows = [(k, v["path"], float(v["seconds"]), v["error"]) for k, v in report.items()]
    return spark.createDataFrame(rows, "view_name string, path string, seconds double, error string") \
        .withColumn("as_of", F.lit(str(as_of)))


def refreshed_counts(spark: SparkSession, report: dict[str, dict]) -> DataFrame:
    """Row count per written view, read back from storage (verifies the write)."""
    parts = [spark.read.parquet(v["path"]).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(k).alias("view_name"), "row_count")
             for k, v in report.items() if v["error"] is None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

