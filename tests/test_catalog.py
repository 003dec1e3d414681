"""Registered queries on tables of their own rows."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as E
from shoplens.checks.compare import digest
from shoplens.plans import catalog
from shoplens.plans import ingest as ING
from shoplens.session import ADVISORY, TASK_BYTES, _bytes, ensure_conf
from shoplens.sources import envelopes as ENVS
from shoplens.sources import storage

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tables(spark, root, events, nations=(0,)):
    rows = [(k, dt.datetime.fromisoformat(ts), uid, kind, value, None) for k, ts, uid, kind, value in events]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{root}/part/events")
    spark.createDataFrame([(n, f"N{n}", 0) for n in nations], "n_nationkey int, n_name string, n_regionkey int") \
        .coalesce(1).write.parquet(f"{root}/part/nation")
    for name in ("events", "nation"):
        (root / f"{name}.parquet").write_bytes(next((root / "part" / name).glob("*.parquet")).read_bytes())
    return str(root)


@pytest.mark.parametrize("key", ["dashboard_kpi_window", "kpi_prev"])
def test_kpi_windows_answer_for_every_shop_of_the_view(spark, tmp_path, key):
    # shop_1 only has events before both windows and isn't in nation; shop_9 is in nation only
    sf = tables(spark, tmp_path, [(1, "2023-12-02 10:00:00", 1, "view", 1.0), (2, "2024-01-29 10:00:00", 2, "view", 1.0),
                                  (3, "2024-01-20 10:00:00", 2, "purchase", 5.0)], nations=(2, 9))
    df = E.queries()[key](spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert sorted(r[0] for r in got) == ["shop_1", "shop_2", "shop_9"]
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    r = con.execute(E.oracle_sql()[key])
    assert digest(df.columns, got) == digest([d[0] for d in r.description], r.fetchall())


def test_filter_on_the_verdict_repeats_no_extraction(spark):
    raw = spark.createDataFrame([(dt.datetime(2024, 1, 1), "", "{}")], ENVS.RAW_SCHEMA)
    plan = ING.flatten(ING.parse_batches(raw).filter("reason IS NULL"))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("variant" in line for line in filters)


@pytest.mark.parametrize("body, reason", [
    ("[]", "invalid_json"), ('{"shop_id":"s","events":null}', "invalid_json"), ('{"shop_id":"s","events":{}}', "invalid_json"),
    ('{"shop_id":"s","events":[null]}', "invalid_json"), ('{"shop_id":"s","events":[1]}', "invalid_json"),
    ('{"shop_id":1,"events":[]}', "invalid_json"), ('{"shop_id":"s"}', "events_count"), ('{"events":[{}]}', "shop_id_required"),
    ('{"shop_id":"s","events":[{"session_id":2}]}', "invalid_json"), ('{"shop_id":"s","events":[{}]}', "session_id_required")])
def test_kinds_are_told_by_what_is_extracted(spark, body, reason):
    raw = spark.createDataFrame([(dt.datetime(2024, 1, 1), "", body)], ENVS.RAW_SCHEMA)
    assert ING.parse_batches(raw).first()["reason"] == reason


def test_micro_batches_of_a_backlog_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "RANGE_ROWS", 1)
    rows = [(k, f"2024-01-{1 + k:02d} 10:00:00", 1, "view", 1.0) for k in range(25)]
    path = catalog._bronze_files(spark, tables(spark, tmp_path, rows), str(tmp_path / "stream"))
    parts = sum(name.startswith("part-") for name, _, _ in storage.entries(spark, path))
    assert parts > 2 * catalog.RANGES
    assert -(-parts // catalog._files_at_once(spark, path, 1)) <= catalog.RANGES
    assert catalog._files_at_once(spark, path, 100) == 100


def test_task_size_is_bounded(spark):
    assert [_bytes(x) for x in ("64MB", "1g", "512", "8k")] == [64 << 20, 1 << 30, 512, 8 << 10]
    spark.conf.set(ADVISORY, "64MB")
    ensure_conf(spark)
    assert _bytes(spark.conf.get(ADVISORY)) == TASK_BYTES
