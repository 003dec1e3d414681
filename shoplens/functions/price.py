"""Flexible price -> integer cents (native column expressions, no UDF).

Rules of the event contract:

* JSON null / missing -> 0
* JSON number -> rounded half away from zero and **taken as cents**
* string -> keep only ``[0-9.,]``; empty or not a plain decimal (so any comma) -> 0;
  a whole value below 100000 is read as roubles (x100), anything else is rounded as is
* boolean / object / array -> 0

No amount can throw: what does not fit 64 bits becomes the largest (smallest) 64-bit
number, which the range guard then sends to quarantine with the row.

Storage then turns 0 into NULL (:func:`shoplens.functions.text.nullify_zero`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_LONG_LIMIT = 9.2e18


def _rounded(x: Column) -> Column:
    """Half away from zero, kept within 64 bits."""
    kept = F.greatest(F.lit(-_LONG_LIMIT), F.least(F.lit(_LONG_LIMIT), x))
    return F.when(F.isnan(x), F.lit(0).cast("long")).otherwise(F.round(kept).cast("long"))


def price_text_to_cents(s) -> Column:
    """String branch. ``try_cast`` accepts '15.' and '.5' and rejects '', '.', '1.2.3'
    and commas, exactly like a strict float parser after the character clean-up."""
    cleaned = F.regexp_replace(_c(s), r"[^0-9.,]", "")
    f = cleaned.try_cast("double")
    whole_roubles = (f < 100000) & (f % 1 == 0)
    cents = (F.when(f.isNull(), F.lit(0).cast("long"))
              .when(whole_roubles, _rounded(f * 100))
              .otherwise(_rounded(f)))
    return F.when(_c(s).isNull(), F.lit(0).cast("long")).otherwise(cents)


def price_number_to_cents(x) -> Column:
    """Numeric branch: half away from zero, the number already is in cents."""
    return _rounded(_c(x).cast("double"))


def price_variant_to_cents(v) -> Column:
    """Any JSON value held in a VARIANT column: dispatch on its JSON type."""
    v = _c(v)
    kind = F.schema_of_variant(v)
    is_num = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")
    return (F.when(v.isNull() | (kind == "VOID"), F.lit(0).cast("long"))
             .when(kind == "STRING", price_text_to_cents(F.variant_get(v, "$", "string")))
             .when(is_num, price_number_to_cents(F.variant_get(v, "$", "double")))
             .otherwise(F.lit(0).cast("long")))
