import ipaddress
import random

from pyspark.sql import functions as F

from shoplens.functions.ip import ip_hex_literal, parse_client_ip, with_client_ip
from shoplens.operators.range_join import geo_lookup
from shoplens.plans.ingest import flatten, ingest, parse_batches


def _addresses(n=6, seed=11):
    """(text, address or None) from the accepted grammar, and the same spoilt in one place."""
    r = random.Random(seed)
    out = [("", None), (None, None), ("::", "::"), ("host.example:80", None)]
    for _ in range(n):
        octets = [str(r.randint(0, 255)) for _ in range(4)]
        v4, port, blank = ".".join(octets), r.randint(1, 65535), " " * r.randint(1, 3)
        v6 = str(ipaddress.IPv6Address(r.getrandbits(128) & ~(0xFFFFFFFF << 16 * r.randint(1, 5))))
        at = r.randrange(4)
        spoilt = [octets[:at] + [x] + octets[at + 1:] for x in (str(r.randint(256, 999)), "0" + octets[at] if octets[at] != "0" else "00")]
        out += [(v4, v4), (f"{blank}{v4}{blank}", v4), (f"{v4}:{port}", v4), (f"\t{v4}", None), (".".join(octets[:3]), None),
                (f"{v4}.{octets[0]}", None), *((".".join(x), None) for x in spoilt),
                (v6, v6), (v6.upper(), v6), (f"[{v6}]:{port}", v6), (f"{v6}%if{port}", v6), (f"[{v6}%if{port}]:{port}", v6),
                (f"::ffff:{v4}", v4), (v6.replace("::", ":0::0:", 1) + "::1", None)]
    return out


def test_parse_client_ip(spark):
    cases = _addresses()
    df = spark.createDataFrame([(a,) for a, _ in cases], "a string")
    want = [ip_hex_literal(w) if w else None for _, w in cases]
    assert [r[0] for r in df.select(parse_client_ip("a")).collect()] == want
    assert [r["ip"] for r in with_client_ip(df, "a", "ip").collect()] == want


def _networks(spark):
    rows = [(ip_hex_literal("192.0.2.0"), ip_hex_literal("192.0.2.255"), "UA", "43",
             {"en": "Crimea"}, {"en": "Simferopol", "ru": "Симферополь"}),
            (ip_hex_literal("198.51.100.0"), ip_hex_literal("198.51.100.255"), "RU", "MOW",
             {"ru": "Москва", "en": "Moscow"}, {"ru": "Москва"}),
            (ip_hex_literal("2001:db8::"), ip_hex_literal("2001:db8:ffff:ffff:ffff:ffff:ffff:ffff"), "US", "CA",
             {"en": "California"}, None)]
    return spark.createDataFrame(rows, "net_lo string, net_hi string, country_iso string, subj_iso string, "
                                       "subj_names map<string,string>, city_names map<string,string>")


def test_geo_lookup(spark):
    addrs = spark.createDataFrame([("192.0.2.10:1",), ("198.51.100.7",), ("[2001:db8::5]:443",), ("203.0.113.1",),
                                   ("nope",)], "a string")
    out = geo_lookup(with_client_ip(addrs, "a", "ip"), "ip", _networks(spark))
    got = {r["a"]: (r["geo_country"], r["geo_subject"], r["geo_city"]) for r in out.collect()}
    assert got["192.0.2.10:1"] == ("RU", "Республика Крым", "Симферополь")  # relabelled by code
    assert got["198.51.100.7"] == ("RU", "Москва", "Москва")
    assert got["[2001:db8::5]:443"] == ("US", "California", None)
    assert got["203.0.113.1"] == (None, None, None)
    assert got["nope"] == (None, None, None)


def _raw(spark, bodies, addr="198.51.100.7", ingest_ts="2026-06-22 12:00:00"):
    return spark.createDataFrame([(ingest_ts, addr, b) for b in bodies], "ingest_ts string, remote_addr string, body string") \
        .withColumn("ingest_ts", F.to_timestamp("ingest_ts"))


def test_batch_validation_all_or_nothing(spark):
    ok_ev = '{"type":"page_view","session_id":"s1"}'
    bodies = {
        "good": f'{{"shop_id":"shop","events":[{ok_ev}]}}',
        "badjson": '{"shop_id":"shop","events":[',
        "noshop": f'{{"shop_id":"","events":[{ok_ev}]}}',
        "empty": '{"shop_id":"shop","events":[]}',
        "toomany": '{"shop_id":"shop","events":[' + ",".join([ok_ev] * 101) + "]}",
        "nosession": f'{{"shop_id":"shop","events":[{ok_ev},{{"type":"page_view","session_id":""}}]}}',
        "badtype": f'{{"shop_id":"shop","events":[{ok_ev},{{"type":"bogus","session_id":"s"}}]}}',
        "badts": '{"shop_id":"shop","events":[{"type":"page_view","session_id":"s","timestamp":"2026-06-22"}]}',
        "old": '{"shop_id":"shop","events":[{"type":"page_view","session_id":"s","timestamp":"2026-06-21T11:59:59Z"}]}',
        "future": '{"shop_id":"shop","events":[{"type":"page_view","session_id":"s","timestamp":"2026-06-23T00:00:00Z"}]}',
        "numshop": f'{{"shop_id":5,"events":[{ok_ev}]}}',
        "numsession": '{"shop_id":"shop","events":[{"type":"page_view","session_id":7}]}',
        "fraccost": '{"shop_id":"shop","events":[{"type":"page_view","session_id":"s","cost_price_cents":1.5}]}',
        "dotcost": '{"shop_id":"shop","events":[{"type":"page_view","session_id":"s","cost_price_cents":1.0}]}',
        "intcost": '{"shop_id":"shop","events":[{"type":"page_view","session_id":"s","cost_price_cents":150}]}',
        "first_reason": '{"shop_id":"shop","events":[{"type":"bogus","session_id":"s"},{"type":"page_view","session_id":""}]}',
    }
    raw = _raw(spark, list(bodies.values()))
    got = dict(zip(bodies, [r["reason"] for r in parse_batches(raw).collect()]))
    assert got == {"good": None, "badjson": "invalid_json", "noshop": "shop_id_required", "empty": "events_count",
                   "toomany": "events_count", "nosession": "session_id_required", "badtype": "invalid_type",
                   "badts": "invalid_timestamp", "old": "too_old", "future": None, "numshop": "invalid_json",
                   "numsession": "invalid_json", "fraccost": "invalid_json", "dotcost": "invalid_json",
                   "intcost": None, "first_reason": "invalid_type"}


def test_ingest_rows(spark):
    body = ('{"shop_id":"flower-42","tenant_id":"north","events":['
            '{"type":"page_view","session_id":"s1","page_url":"","product_price":null},'
            '{"type":"purchase","session_id":"s1","order_id":"o9","product_price":1234,"order_total":"5678",'
            '"shop_id":"","timestamp":"2026-06-22T11:00:00Z"}]}')
    good, rejected, bad = ingest(_raw(spark, [body]), _networks(spark))
    rows = sorted(good.collect(), key=lambda r: r["id"])
    assert rejected.count() == 0 and bad.count() == 0 and len(rows) == 2
    pv, pu = rows
    assert pv["page_url"] is None and pv["product_price_cents"] is None
    assert pv["created_at"].isoformat() == "2026-06-22T12:00:00"  # missing timestamp -> ingest time
    assert pu["shop_id"] == "flower-42" and pu["tenant_id"] == "north"
    assert pu["product_price_cents"] == 1234 and pu["order_total_cents"] == 567800
    assert all(r["geo_country"] == "RU" and r["geo_subject"] == "Москва" for r in rows)
    assert "remote_addr" not in good.columns and "body" not in good.columns


def test_out_of_range_is_quarantined(spark):
    body = '{"shop_id":"s","events":[{"type":"purchase","session_id":"s1","order_total":99999999999}]}'
    good, _, bad = ingest(_raw(spark, [body]), _networks(spark))
    assert good.count() == 0 and bad.count() == 1


def test_no_price_stops_the_job(spark):
    amounts = ['"99999999999999999999999"', "1e30", "-1e30", "2147483648", "2147483647", '"21474836.5"', "0"]
    events = ",".join(f'{{"type":"purchase","session_id":"s{k}","order_total":{a}}}' for k, a in enumerate(amounts))
    good, rejected, bad = ingest(_raw(spark, [f'{{"shop_id":"s","events":[{events}]}}']), _networks(spark))
    assert rejected.count() == 0
    assert {r.session_id: r.order_total_cents for r in good.collect()} == {"s4": 2147483647, "s5": 21474837, "s6": None}
    assert {r.session_id: r.order_total_cents for r in bad.collect()} == {
        "s0": 9200000000000000000, "s1": 9200000000000000000, "s2": -9200000000000000000, "s3": 2147483648}


def test_networks_of_any_width(spark):
    def net(lo, hi, country):
        return lo, hi, country, None, {"en": country}, None

    def parts(cidr):
        import ipaddress
        n = ipaddress.ip_network(cidr)
        lo, hi = int(n[0]), int(n[-1])
        base = 0 if n.version == 6 else 0xFFFF << 32
        return f"{base + lo:032x}", f"{base + hi:032x}"

    schema = ("net_lo string, net_hi string, country_iso string, subj_iso string, subj_names map<string,string>, "
              "city_names map<string,string>")
    some = [net(*parts(c), k) for c, k in (("2000::/12", "AA"), ("2010::/64", "BB"), ("192.0.2.128/25", "CC"),
                                           ("192.0.2.7/32", "DD"))]
    some.append(net(f"{(0xFFFF << 32) + 0x09FF0000:032x}", f"{(0xFFFF << 32) + 0x0A0000FF:032x}", "EE"))
    addrs = spark.createDataFrame([(a,) for a in ("2005::1", "2010::5", "2011::1", "192.0.2.200", "192.0.2.7", "192.0.2.8",
                                                  "9.255.1.1", "10.0.0.255", "10.0.1.0", "none", "2005::1")], "a string")
    asked = with_client_ip(addrs, "a", "ip")
    got = sorted((r.a, r.geo_country) for r in geo_lookup(asked, "ip", spark.createDataFrame(some, schema)).collect())
    assert got == sorted([("2005::1", "AA"), ("2005::1", "AA"), ("2010::5", "BB"), ("2011::1", None), ("192.0.2.200", "CC"),
                          ("192.0.2.7", "DD"), ("192.0.2.8", None), ("9.255.1.1", "EE"), ("10.0.0.255", "EE"),
                          ("10.0.1.0", None), ("none", None)])
    everything = spark.createDataFrame([net("0" * 32, "f" * 32, "ZZ")], schema)
    assert {r.geo_country for r in geo_lookup(asked, "ip", everything).where("ip IS NOT NULL").collect()} == {"ZZ"}
    assert {r.geo_country for r in geo_lookup(asked, "ip", everything.limit(0)).collect()} == {None}


def test_body_limit(spark):
    from shoplens.constants import MAX_BODY_BYTES
    ok_ev = '{"type":"page_view","session_id":"s1"}'
    doc = f'{{"shop_id":"shop","events":[{ok_ev}]}}'
    padded = doc + " " * (MAX_BODY_BYTES - len(doc) + 10)   # only blanks beyond the limit
    long_name = '{"shop_id":"shop","events":[{"type":"page_view","session_id":"s1","page_title":"' + \
        "x" * MAX_BODY_BYTES + '"}]}'
    got = [r["reason"] for r in parse_batches(_raw(spark, [padded, long_name])).collect()]
    assert got == [None, "invalid_json"]


def test_kafka_records_map_to_raw(spark):
    import datetime as dt

    from shoplens.sources.envelopes import kafka_records_to_raw
    rows = [(b'{"shop_id":"s","events":[]}', dt.datetime(2026, 6, 22, 12), [("remote_addr", b"1.2.3.4:5"), ("x", b"y")]),
            (b"{}", dt.datetime(2026, 6, 22, 13), [])]
    k = spark.createDataFrame(rows, "value binary, timestamp timestamp, headers array<struct<key: string, value: binary>>")
    got = [tuple(r) for r in kafka_records_to_raw(k).collect()]
    assert got == [(dt.datetime(2026, 6, 22, 12), "1.2.3.4:5", '{"shop_id":"s","events":[]}'),
                   (dt.datetime(2026, 6, 22, 13), None, "{}")]


def test_one_scan_one_parse_and_no_payload_in_an_exchange(spark, tmp_path):
    import re

    from shoplens.plans.ingest import bronze_rows, parsed, rejected_batches, write_parsed
    from shoplens.sources import envelopes as ENV
    body = '{"shop_id":"s","events":[{"type":"page_view","session_id":"s1"}]}'
    ENV.write(_raw(spark, [body, "{"]), str(tmp_path / "raw"))
    execution = parsed(ENV.read(spark, str(tmp_path / "raw")))._jdf.queryExecution()
    plan = execution.executedPlan().toString()
    assert len(re.findall(r"FileScan json", plan)) == 1 and "Exchange" not in plan
    assert len(re.findall(r"parseJson|ParseJson|parse_json", execution.optimizedPlan().toString())) == 1
    made, labels = write_parsed(ENV.read(spark, str(tmp_path / "raw")), _networks(spark), str(tmp_path / "staged"))
    for df in (bronze_rows(made, labels), rejected_batches(made)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanged = [x for x in re.split(r"\n", plan) if "Exchange" in x]
        assert not any("body" in x for x in exchanged) and "/raw" not in plan
        assert all("Broadcast" in x for x in exchanged)
    assert bronze_rows(made, labels).count() == rejected_batches(made).count() == 1
