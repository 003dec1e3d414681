import json

from pyspark.sql import functions as F

from shoplens.operators.pixels import active_pixels, fold, list_pixels
from shoplens.plans import reports as R
from shoplens.sources.pixels import FEED_SCHEMA


def _feed(spark, rows):
    cols = [c.split(" ")[0] for c in FEED_SCHEMA.split(", ")]
    data = [tuple(r.get(c) for c in cols[:-1]) + (None,) for r in rows]
    df = spark.createDataFrame(data, FEED_SCHEMA.replace("ts timestamp", "ts string"))
    return df.withColumn("ts", F.to_timestamp(F.concat(F.lit("2026-06-01 00:00:"),
                                                       F.lpad(F.col("seq").cast("string"), 2, "0"))))


def test_fold_rules(spark):
    rows = [
        dict(seq=1, op="create", id="a", shop_id="s", tenant_id="t", pixel_type="vk", pixel_id="1", name="A"),
        dict(seq=2, op="update", id="a", tenant_id="t", name="A2"),
        dict(seq=3, op="update", id="a", tenant_id="other", name="HACK", is_active=False),  # foreign tenant
        dict(seq=4, op="update", id="a", tenant_id="t", is_active=False),
        dict(seq=5, op="create", id="b", shop_id="s", tenant_id="t", pixel_type="meta", pixel_id="2"),
        dict(seq=6, op="delete", id="b", tenant_id="t"),
        dict(seq=7, op="update", id="b", tenant_id="t", name="after delete"),
        dict(seq=8, op="create", id="c", shop_id="s", tenant_id="t", pixel_type="bogus", pixel_id="3"),
        dict(seq=9, op="create", id="d", shop_id="s", tenant_id="t", pixel_type="vk", pixel_id="1"),  # same key as a
        dict(seq=10, op="create", id="a", shop_id="s", tenant_id="t", pixel_type="custom", pixel_id="9"),  # dup id
        dict(seq=11, op="create", id="e", shop_id="s", tenant_id="t", pixel_type="google_analytics", pixel_id="5"),
        dict(seq=12, op="update", id="e", tenant_id="t", pixel_id="6"),
    ]
    reg = {r["id"]: r.asDict() for r in fold(_feed(spark, rows)).collect()}
    assert set(reg) == {"a", "e"}
    assert (reg["a"]["name"], reg["a"]["is_active"], reg["a"]["pixel_type"]) == ("A2", False, "vk")
    assert reg["e"]["pixel_id"] == "6" and reg["e"]["name"] is None and reg["e"]["is_active"] is True
    listed = list_pixels(fold(_feed(spark, rows)), "s", "t").orderBy("position").collect()
    assert [r["id"] for r in listed] == ["e", "a"] and listed[0]["name"] == ""
    act = active_pixels(fold(_feed(spark, rows)), "s").collect()
    assert [(r["pixel_type"], r["pixel_id"]) for r in act] == [("google_analytics", "6")]


def test_uncontested_ids_equal_the_replay(spark, monkeypatch):
    """The aggregation gives what a replay of all operations gives."""
    import random

    from shoplens.operators import pixels
    r = random.Random(5)
    rows = [dict(seq=k, op=r.choice(["create", "update", "update", "update", "delete"]), id=f"i{r.randint(0, 14)}", shop_id="s",
                 tenant_id=r.choice(["t", "t", "t", "u"]), pixel_type="vk", pixel_id=r.choice([None, f"p{r.randint(0, 60)}"]),
                 name=r.choice([None, f"n{k}"]), is_active=r.choice([None, True, False])) for k in range(59)]
    got = sorted(map(tuple, fold(_feed(spark, rows)).collect()))
    monkeypatch.setattr(pixels, "_folded", lambda ops: ops.repartition("shop_id", "pixel_type")
                        .sortWithinPartitions("seq").mapInPandas(pixels._replay, pixels.REGISTRY_SCHEMA))
    assert got and got == sorted(map(tuple, fold(_feed(spark, rows)).collect()))


def test_a_refused_update_leaves_the_pixel(spark):
    rows = [dict(seq=1, op="create", id="A", shop_id="s", tenant_id="t", pixel_type="vk", pixel_id="P1"),
            dict(seq=2, op="create", id="B", shop_id="s", tenant_id="t", pixel_type="vk", pixel_id="P2", name="b"),
            dict(seq=3, op="update", id="B", tenant_id="t", pixel_id="P1", name="refused as a whole"),
            dict(seq=4, op="update", id="B", tenant_id="t", is_active=False)]
    got = {r["id"]: (r["pixel_id"], r["name"], r["is_active"]) for r in fold(_feed(spark, rows)).collect()}
    assert got == {"A": ("P1", None, True), "B": ("P2", "b", False)}


def test_a_refused_create_does_not_come_back(spark):
    rows = [dict(seq=1, op="create", id="A", shop_id="s", tenant_id="t", pixel_type="vk", pixel_id="P1"),
            dict(seq=2, op="create", id="B", shop_id="s", tenant_id="t", pixel_type="vk", pixel_id="P1"),
            dict(seq=3, op="delete", id="A", tenant_id="t"),
            dict(seq=4, op="update", id="B", tenant_id="t", name="never was"),
            dict(seq=5, op="create", id="C", shop_id="s", tenant_id="t", pixel_type="vk", pixel_id="P1"),
            dict(seq=6, op="create", id="D", shop_id="s", tenant_id="t", pixel_type="meta", pixel_id="P1")]
    assert {r["id"] for r in fold(_feed(spark, rows)).collect()} == {"C", "D"}


def test_channels_document(spark):
    rows = [("s1", "t", "2026-06-01", "google", "cpc", None, 10, 2, 500),
            ("s1", "t", "2026-06-01", "direct", None, None, 20, 1, 100),
            ("s1", "t", "2026-06-02", "google", "cpc", None, 5, 0, None)]
    ch = spark.createDataFrame(rows, "shop_id string, tenant_id string, day string, channel string, utm_medium string, "
                                     "utm_campaign string, sessions long, orders long, revenue_cents long") \
        .withColumn("day", F.to_date("day"))
    w = R.window("custom", "2026-06-10 00:00:00", "2026-06-01", "2026-06-09")
    doc = json.loads(R.channels_document(ch, w).first()["document"])
    assert [c["source"] for c in doc["channels"]] == ["direct", "google"]
    assert doc["channels"][1]["sessions"] == 15 and doc["channels"][1]["conversion_rate"] == 2 / 15 * 100
    assert [d["day"] for d in doc["time_series"]] == ["2026-06-01", "2026-06-02"]
    assert [c["source"] for c in doc["time_series"][0]["channels"]] == ["direct", "google"]
