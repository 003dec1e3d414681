"""Storage normalisation: optional text '' -> NULL, money 0 -> NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# optional text fields of an event that are stored as NULL when empty
OPTIONAL_TEXT = ("tenant_id", "visitor_id", "page_url", "page_title", "referrer", "utm_source",
                 "utm_medium", "utm_campaign", "product_id", "product_name", "order_id",
                 "geo_country", "geo_subject", "geo_city")


def nullify_empty(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))


def nullify_zero(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(0))


# 32-bit signed range of the stored money columns
INT32_MIN, INT32_MAX = -(2 ** 31), 2 ** 31 - 1


def in_int32(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | c.between(INT32_MIN, INT32_MAX)
