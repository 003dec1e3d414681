"""Client address text -> 128-bit address as 32 lower-case hex digits (native expressions).

Accepted shapes: ``a.b.c.d``, ``a.b.c.d:port``, ``[v6]:port``, bare v6 (with ``::``
and an embedded IPv4 tail), v6 with a ``%zone``; surrounding blanks are trimmed.
Anything else gives NULL. IPv4 is mapped into IPv6 (``::ffff:a.b.c.d``) so that both
families share one key space; an IPv4 octet may not carry a leading zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V4_PREFIX = "00000000000000000000ffff"
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def strip_host(addr) -> Column:
    """Remove ``:port`` (and the brackets of ``[v6]:port``), then an IPv6 ``%zone``."""
    s = F.trim(F.col(addr) if isinstance(addr, str) else addr)
    host = (F.when(s.rlike(r"^\[[^\]]*\]:[^:\[\]]*$"), F.regexp_extract(s, r"^\[([^\]]*)\]:", 1))
             .when(s.rlike(r"^[^:\[\]]*:[^:\[\]]*$"), F.regexp_extract(s, r"^([^:]*):", 1))
             .otherwise(s))
    return F.trim(F.regexp_replace(host, r"%.*$", ""))


def _v4_hex(s: Column) -> Column:
    parts = F.split(s, r"\.")
    return F.concat_ws("", *[F.lpad(F.lower(F.hex(parts[i].cast("int"))), 2, "0") for i in range(4)])


def _v6_hex(s: Column) -> Column:
    s = F.lower(s)
    tail4 = F.regexp_extract(s, rf"({_V4})$", 1)
    # an embedded IPv4 tail becomes two hex groups
    s2 = F.when(tail4 != "", F.concat(F.regexp_replace(s, rf"{_V4}$", ""),
                                      F.substring(_v4_hex(tail4), 1, 4), F.lit(":"),
                                      F.substring(_v4_hex(tail4), 5, 4))).otherwise(s)
    halves = F.split(s2, "::", -1)

    def groups(x: Column) -> Column:
        return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    head, tail = groups(halves[0]), groups(F.element_at(halves, -1))
    fill = 8 - F.size(head) - F.size(tail)
    g = (F.when(F.size(halves) == 1, F.split(s2, ":"))
          .when((F.size(halves) == 2) & (fill >= 1),
                F.concat(head, F.array_repeat(F.lit("0"), fill), tail)))
    ok = (s.rlike(r"^[0-9a-f:.]+$") & s.contains(":") & (F.size(g) == 8)
          & F.forall(g, lambda x: x.rlike(r"^[0-9a-f]{1,4}$")))
    return F.when(ok, F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))


def parse_client_ip(addr) -> Column:
    """32-hex-digit address of a client address string, or NULL when unparsable."""
    h = strip_host(addr)
    return (F.when(h.rlike(rf"^{_V4}$"), F.concat(F.lit(V4_PREFIX), _v4_hex(h)))
             .when(h.contains(":"), _v6_hex(h)))


def ip_hex_literal(text: str) -> str:
    """Driver-side helper for building network tables in tests (Python ipaddress)."""
    import ipaddress
    ip = ipaddress.ip_address(text)
    if ip.version == 4:
        ip = ipaddress.IPv6Address("::ffff:" + text)
    return f"{int(ip):032x}"


def with_client_ip(df: DataFrame, addr: str, out: str = "ip_hex") -> DataFrame:
    """``parse_client_ip`` as staged projections: the host text and the IPv6 groups are
    computed once each and then referenced, instead of re-evaluating the regexes inside
    every branch of one large expression (same result, several times faster).

    Each step is pinned by an always true condition that isn't deterministic: the optimizer would else put
    the steps together again, and a filter on the result would repeat all of them for each of its uses."""
    def once(c: Column) -> Column:
        return F.when(F.spark_partition_id() >= 0, c)

    h, s, s2, g = "_ip_h", "_ip_s", "_ip_s2", "_ip_g"
    d = df.withColumn(h, once(strip_host(addr)))
    d = d.withColumn(s, once(F.when(~F.col(h).rlike(rf"^{_V4}$") & F.col(h).contains(":"), F.lower(h))))
    tail4 = F.regexp_extract(F.col(s), rf"({_V4})$", 1)
    d = d.withColumn(s2, once(F.when(tail4 != "", F.concat(
        F.regexp_replace(F.col(s), rf"{_V4}$", ""), F.substring(_v4_hex(tail4), 1, 4), F.lit(":"),
        F.substring(_v4_hex(tail4), 5, 4))).otherwise(F.col(s))))
    halves = F.split(F.col(s2), "::", -1)

    def groups(x: Column) -> Column:
        return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    head, tail = groups(halves[0]), groups(F.element_at(halves, -1))
    fill = 8 - F.size(head) - F.size(tail)
    d = d.withColumn(g, once(F.when(F.col(s).rlike(r"^[0-9a-f:.]+$"), F.when(F.size(halves) == 1, F.split(F.col(s2), ":"))
                     .when((F.size(halves) == 2) & (fill >= 1), F.concat(head, F.array_repeat(F.lit("0"), fill), tail)))))
    ok = (F.size(g) == 8) & F.forall(g, lambda x: x.rlike(r"^[0-9a-f]{1,4}$"))
    v6 = F.when(ok, F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))
    v4 = F.when(F.col(h).rlike(rf"^{_V4}$"), F.concat(F.lit(V4_PREFIX), _v4_hex(F.col(h))))
    return d.withColumn(out, once(F.coalesce(v4, v6))).drop(h, s, s2, g)
