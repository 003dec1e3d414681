import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shoplens.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app="shoplens-tests")
    yield s
    s.stop()


def events_df(spark, rows):
    """Bronze-shaped frame from (shop, tenant, session, visitor, type, created_at, order_id,
    order_total_cents, product_id, product_name, product_price_cents, geo...) dicts."""
    from pyspark.sql import functions as F

    from shoplens.sources.bronze import BRONZE_SCHEMA
    cols = [c.split(" ")[0] for c in BRONZE_SCHEMA.split(", ")]
    data = []
    for i, r in enumerate(rows):
        d = {c: None for c in cols}
        d.update(r)
        d.setdefault("id", str(i))
        if d["id"] is None:
            d["id"] = str(i)
        data.append(d)
    df = spark.createDataFrame([tuple(d[c] if c not in ("created_at", "event_timestamp", "event_month") else None
                                      for c in cols) for d in data], BRONZE_SCHEMA)
    ts = spark.createDataFrame([(d["id"], d["created_at"]) for d in data], "id string, ts string")
    df = df.drop("created_at", "event_timestamp", "event_month").join(ts, "id")
    df = df.withColumn("created_at", F.to_timestamp("ts")).withColumn("event_timestamp", F.col("created_at"))
    return df.withColumn("event_month", F.trunc(F.to_date("created_at"), "MM")).drop("ts").select(*cols)
