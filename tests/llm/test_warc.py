"""WARC: records and index round trip, revisits, lookups by URL."""

import gzip

import pytest

from shoplens.llm import warc
from shoplens.llm.common import fresh_path

LONG = "<p>" + "x" * 120 + "</p>"
PAGES = [(3, "http://www.Example.com/b?q=1", LONG), (1, "https://example.com:8443/a b", LONG), (2, None, LONG),
         (4, "http://h.example.org", "é" * 49), (5, "http://h.example.org", "é" * 49), (6, "http://h.example.org", None),
         (7, "http://h.example.org/", ""), (8, "http://[bad/", "WARC/1.1\r\n\r\nWARC/1.1\r\n\r\n"), (1, "http://again/", LONG),
         (None, "http://no.id/", LONG), (9, "http://x\r\nevil: 1", "é" * 50), (10, "http://x/", "é" * 50)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "0 AS size", "1 AS digest")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()]
    n = len(LONG)
    want = [(1, n, "response", None), (1, n, "response", None), (2, n, "revisit", 1), (3, n, "revisit", 1),
            (None, n, "revisit", 1), (4, 98, "response", None), (5, 98, "response", None), (6, 0, "response", None),
            (7, 0, "response", None), (8, 24, "response", None), (9, 100, "response", None), (10, 100, "revisit", 9)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(spark, pages.limit(0)).collect() == []


def test_lookup_reads_all_records_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    pages = spark.createDataFrame(PAGES + [(100 + k, "http://hot.example.org/", f"page {k}") for k in range(30)],
                                  "page_id long, url string, html string")
    root = fresh_path(spark, "test-warc")
    directory = warc.write_index(warc.write_archives(pages, f"{root}/a"), f"{root}/i")
    urls = spark.createDataFrame([("http://HOT.example.org",), ("http://h.example.org/",), ("http://absent.org/",), (None,)],
                                 "url string")
    found = warc.lookup(urls, directory, f"{root}/a", f"{root}/i").collect()
    assert sorted(r.page_id for r in found) == [2, 4, 5, 6, 7, *range(100, 130)]


def test_hot_and_long_keys_over_many_files_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "FILE_LINES", 20)
    monkeypatch.setattr(warc, "HELD_RECORDS", 3)
    monkeypatch.setattr(warc, "TASK_BYTES", 2000)
    long = "http://long.example.org/" + "a" * 5000
    rows = [(k, None if k % 3 == 0 else f"{long}{k % 7}" if k % 3 == 1 else f"http://h{k % 40}.org/", f"page {k % 50}" * 20)
            for k in range(300)] + [(1000, "http://big.org/", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' AS key", "1 AS file", "2 AS first")
    got = warc.round_trip(spark, pages)
    assert got.rdd.getNumPartitions() > 4
    want = {r[0]: len(r[2]) for r in rows}
    found = got.collect()
    assert len(found) == len(rows) and {r.page_id: r.payload_bytes for r in found} == want
    assert all(r.payload is None or len(r.payload) == r.payload_bytes for r in found)


@pytest.mark.parametrize("url, key", [
    ("http://m.casino.example.com/en/1?b=2#top", "com,example,casino,m)/en/1?b=2"), ("https://www.A.org:443", "org,a)/"),
    ("http://a.org:81/X", "org,a:81)/x"), (None, "-"), ("", "-"), ("not a url", "not%20a%20url"), ("http://[", "http://[")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_damaged_records_are_errors():
    raw = warc.record(1, "http://x/", b"payload", "0" * 64, 7, None)
    for bad in (raw, raw[:-1], raw.replace(b"payload", b"pay")):
        with pytest.raises(ValueError):
            warc.parsed(gzip.decompress(gzip.compress(bad)))
