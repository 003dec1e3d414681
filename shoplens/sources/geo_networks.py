"""Geo network dimension: (net_lo, net_hi) address ranges -> country, subdivision, city.

Columns: ``net_lo, net_hi`` (32 hex digits, inclusive), ``country_iso``, ``subj_iso``,
``subj_names``, ``city_names`` (maps language -> name). A real deployment loads it from
a converted geo database (``read``); the test bridge derives one network per ``nation``
row (an IPv4 /16 and an IPv6 /48 each), so the table grows with the input tables.
Networks must not overlap (as in a prefix-trie geo database); ``overlaps`` checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ip import V4_PREFIX

GEO_NETWORK_SCHEMA = ("net_lo string, net_hi string, country_iso string, subj_iso string, "
                      "subj_names map<string,string>, city_names map<string,string>")

# --- fixed values of the derived test dimension (not service data) ------------------------
_COUNTRIES = ("RU", "UA", "US", "DE", "KZ")
_UA_CODES = ("43", "40", "14", "09", "23", "65", "30")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GEO_NETWORK_SCHEMA).parquet(path)


def networks_from_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    kh = F.lpad(F.lower(F.hex(k)), 2, "0")
    k4 = F.lpad(F.lower(F.hex(k)), 4, "0")
    country = F.element_at(F.array(*[F.lit(c) for c in _COUNTRIES]), (k % len(_COUNTRIES) + 1).cast("int"))
    code = F.when(country == "UA", F.element_at(F.array(*[F.lit(c) for c in _UA_CODES]),
                                                (k % len(_UA_CODES) + 1).cast("int")))
    subj_en = F.concat(F.lit("Region "), F.col("n_name"))
    subj_ru = F.when(k % 3 == 0, F.lit(""))\
        .otherwise(F.concat(F.lit("Регион "), k.cast("string")))
    city_en = F.when(k % 4 != 3, F.concat(F.lit("City "), k.cast("string")))
    names = F.create_map(F.lit("en"), subj_en, F.lit("ru"), subj_ru)
    cities = F.when(city_en.isNotNull(), F.create_map(F.lit("en"), city_en, F.lit("de"),
                                                      F.concat(F.lit("Stadt "), k.cast("string"))))
    v4 = n.select(F.concat(F.lit(V4_PREFIX), F.lit("0a"), kh, F.lit("0000")).alias("net_lo"),
                  F.concat(F.lit(V4_PREFIX), F.lit("0a"), kh, F.lit("ffff")).alias("net_hi"),
                  country.alias("country_iso"), code.alias("subj_iso"), names.alias("subj_names"),
                  cities.alias("city_names"))
    v6 = n.select(F.concat(F.lit("20010db8"), k4, F.lit("0" * 20)).alias("net_lo"),
                  F.concat(F.lit("20010db8"), k4, F.lit("f" * 20)).alias("net_hi"),
                  country.alias("country_iso"), code.alias("subj_iso"), names.alias("subj_names"),
                  cities.alias("city_names"))
    return v4.unionByName(v6)


def overlaps(networks: DataFrame) -> DataFrame:
    """Pairs of consecutive networks (by net_lo) whose ranges overlap; empty when valid."""
    # ranges never cross a /32 prefix in the supported layouts, so the check runs per prefix
    w = Window.partitionBy(F.substring("net_lo", 1, 8)).orderBy("net_lo")
    prev_hi = F.lag("net_hi").over(w)
    return networks.withColumn("prev_hi", prev_hi).filter(F.col("prev_hi") >= F.col("net_lo"))
