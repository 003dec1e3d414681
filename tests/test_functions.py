from pyspark.sql import functions as F

from shoplens.functions import geo as G
from shoplens.functions.price import price_text_to_cents, price_variant_to_cents
from shoplens.functions.rates import pct_2dp, round_ratio_pct, round_share, safe_rate
from shoplens.functions.text import nullify_zero
from shoplens.functions.urls import query_param


def test_round_share(spark):
    rows = [(7, 0), (0, 9), (1, 7), (5, 6), (1, 16), (6, 7), (9, 9), (12345, 99999), (1, 20001), (3, -4)]
    df = spark.createDataFrame(rows, "s long, t long")
    got = [r[0] for r in df.select(round_share("s", "t")).collect()]
    assert got == [0, 0, 14.29, 83.33, 6.25, 85.71, 100, 12.35, 0, 0]


def test_pct_2dp_half_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (1, 10), (1, 3), (2, 3), (0, 5)], "a long, b long")
    got = [r[0] for r in df.select(pct_2dp("a", "b")).collect()]
    assert got == [12.5, -12.5, 10.0, 33.33, 66.67, 0.0]


def test_safe_rate_and_repeat_rate(spark):
    df = spark.createDataFrame([(5, 0), (3, 4), (9, 4)], "c long, t long")
    assert [r[0] for r in df.select(safe_rate("c", "t")).collect()] == [0.0, 75.0, 100.0]
    assert [r[0] for r in df.select(round_ratio_pct("c", "t")).collect()] == [0.0, 7500.0 / 100, 225.0]


def test_price_strings(spark):
    cases = [("15 ₽", 1500), ("1 200,50", None), ("12.50", 13), ("100000", 100000), ("", None),
             (None, None), ("99999", 9999900), ("15.", 1500), (".5", 1), ("1.2.3", None), ("abc", None)]
    df = spark.createDataFrame([(s,) for s, _ in cases], "s string")
    got = [r[0] for r in df.select(nullify_zero(price_text_to_cents("s"))).collect()]
    assert got == [c for _, c in cases]


def test_price_json_values(spark):
    docs = ['{"p": "15 ₽"}', '{"p": 1500}', '{"p": 15.5}', '{"p": null}', '{"p": true}', '{}',
            '{"p": {"a": 1}}', '{"p": "12.50"}']
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    v = F.variant_get(F.parse_json("j"), "$.p", "variant")
    got = [r[0] for r in df.select(nullify_zero(price_variant_to_cents(v))).collect()]
    assert got == [1500, 1500, 16, None, None, None, None, 13]


def test_region_relabel(spark):
    stems = {"krym": None, "Autonomous Republic of Crimea": G.SUBJ_CRIMEA, "sevastopol city": G.SUBJ_SEVASTOPOL,
             "KHERSONSKA": G.SUBJ_KHERSON, "Zaporizhia": None, "Luhansk region": G.SUBJ_LUHANSK,
             "donetsk": G.SUBJ_DONETSK, "Херсонская область": G.SUBJ_KHERSON, "Odesa": None}
    rows = [("UA", name, None) for name in stems] + [
        ("UA", "Odesa", "14"), ("UA", "no such place", "09"), ("FR", "Odesa", "14"), ("FR", "Luhansk Bistro Quarter", None),
        ("UA", None, None), (None, "Paris", "40")]
    df = spark.createDataFrame(rows, "c string, s string, iso string")
    got = [tuple(r) for r in df.select(*G.region_relabel("c", "s", "iso")).collect()]
    for (name, subject), row in zip(stems.items(), got):
        if subject:
            assert row == ("RU", subject)
    assert got[stems_at(stems, "Odesa")] == ("UA", "Odesa")
    by_code, other_code, abroad, stem_abroad, unknown, nowhere = got[len(stems):]
    assert by_code == ("RU", G.SUBJ_DONETSK) and other_code == ("RU", G.SUBJ_LUHANSK)
    assert abroad == ("FR", "Odesa")  # codes count under UA only, stems under any country
    assert stem_abroad == ("RU", G.SUBJ_LUHANSK)
    assert unknown[0] == "UA" and nowhere[1] == "Paris"


def stems_at(stems, name):
    return list(stems).index(name)


def test_pick_name(spark):
    df = spark.createDataFrame([({"ru": "Москва", "en": "Moscow"},), ({"ru": "", "en": "Moscow"},),
                                ({"de": "Moskau", "fr": "Moscou"},), ({},)],
                               "m map<string,string>")
    assert [r[0] for r in df.select(G.pick_name("m")).collect()] == ["Москва", "Moscow", "Moscou", None]


def test_query_param(spark):
    urls = ["https://a.ru/x?utm_source=ya%20direct&utm_medium=cpc", "https://a.ru/x#?utm_source=no",
            "https://a.ru/x?a=1&utm_source=&b=2", "https://a.ru/x?utm_source=a+b", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(query_param("u", "utm_source")).collect()] == \
        ["ya direct", None, None, "a+b", None]
