"""Query-string parameters of a landing URL (the tracker's UTM capture).

Same rule as the browser script: the value after ``[?&]name=`` up to the next ``&`` in
the search part (before any ``#``), percent-decoded; missing -> NULL. Percent-decoding
keeps '+' (it is not a space in decodeURIComponent)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_param(url, name: str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    search = F.regexp_extract(url, r"^[^#?]*(\?[^#]*)", 1)
    raw = F.regexp_extract(search, rf"[?&]{re.escape(name)}=([^&]*)", 1)
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.nullif(decoded, F.lit(""))


def utm_columns(url) -> list[Column]:
    return [query_param(url, n).alias(n) for n in ("utm_source", "utm_medium", "utm_campaign")]
