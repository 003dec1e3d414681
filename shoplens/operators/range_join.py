"""Address-in-network range join (geo lookup).

``ip BETWEEN net_lo AND net_hi`` alone can only be planned as a nested loop join. Addresses are
32 hex digits, so a network has one key: the digits its two ends share (none for a network
that spans the whole space). An address lies in the network only if it begins with that key, so
it is looked up by its beginnings of the lengths that occur among the keys (at most 33), an
equi-join with the range as residual condition:

* a network is one row, however wide it is;
* networks with the same key straddle a border between the key's next digits, and since networks
  must not overlap, a key has at most 15 of them;
* each distinct address is looked up once, by itself; the labels are joined back, so no payload
  is multiplied or moved by a network key. Rows without an address are dealt out by a hash.

Whether the network side is broadcast is Spark's decision by its size in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import pick_name, region_relabel

DIGITS = 32


def _shared_digits(lo: Column, hi: Column) -> Column:
    """Number of leading digits that both ends share."""
    same = F.transform(F.sequence(F.lit(1), F.lit(DIGITS)), lambda k: F.substring(lo, F.lit(1), k) == F.substring(hi, F.lit(1), k))
    return F.size(F.filter(same, lambda x: x))


def network_keys(networks: DataFrame) -> DataFrame:
    """Networks with ``digits`` and ``key``, their ends' common beginning."""
    d = networks.withColumn("digits", _shared_digits(F.col("net_lo"), F.col("net_hi")))
    return d.withColumn("key", F.substring("net_lo", F.lit(1), F.col("digits")))


def geo_labels(addresses: DataFrame, ip_hex: str, networks: DataFrame) -> DataFrame:
    """(_ip, geo_country, geo_subject, geo_city) of the located ones among the distinct ``addresses``."""
    nets = network_keys(networks).select(
        "digits", "key", "net_lo", "net_hi", F.col("country_iso").alias("_country"),
        F.col("subj_iso").alias("_subj_iso"), pick_name("subj_names").alias("_subject"),
        pick_name("city_names").alias("_city"))
    lengths = sorted(r["digits"] for r in nets.select("digits").distinct().collect())  # 33 at most
    beginnings = F.array(*[F.struct(F.lit(n).alias("digits"), F.substring("_ip", 1, n).alias("key")) for n in lengths]) \
        if lengths else F.array().cast("array<struct<digits: int, key: string>>")
    asked = addresses.filter(F.col(ip_hex).isNotNull()).select(F.col(ip_hex).alias("_ip")).distinct() \
        .select("_ip", F.inline(beginnings))
    country, subject = region_relabel(F.col("_country"), F.col("_subject"), F.col("_subj_iso"))
    return asked.join(nets, ["digits", "key"]).filter(F.col("_ip").between(F.col("net_lo"), F.col("net_hi"))).select(
        "_ip", F.nullif(country, F.lit("")).alias("geo_country"), F.nullif(subject, F.lit("")).alias("geo_subject"),
        F.nullif(F.col("_city"), F.lit("")).alias("geo_city"))


def with_labels(df: DataFrame, ip_hex: str, labels: DataFrame) -> DataFrame:
    """``df`` with the columns of ``geo_labels``, NULL on a miss. Rows without an address are dealt out by a hash."""
    plain = [c for c, t in df.dtypes if t in ("string", "timestamp", "bigint", "int")]
    at = F.coalesce(F.col(ip_hex), F.concat(F.lit("none "), F.xxhash64(*plain).cast("string")))
    return df.withColumn("_at", at).join(labels, F.col("_at") == F.col("_ip"), "left").drop("_at", "_ip")


def geo_lookup(df: DataFrame, ip_hex: str, networks: DataFrame) -> DataFrame:
    """Adds geo_country, geo_subject, geo_city (relabelled; NULLs on a miss). Reads ``df`` again for its
    addresses: where it is costly to make, write it first."""
    return with_labels(df, ip_hex, geo_labels(df, ip_hex, networks))
