"""Event and envelope validation (the collect contract), all native expressions.

Per event, in order, the first failing rule is the reason:
``session_id_required``, ``invalid_type``, ``invalid_timestamp`` (not RFC 3339),
``too_old`` (event time more than 24 h before ingest). A missing timestamp is valid and
defaults to the ingest time; a future time is valid. An envelope is accepted or rejected
as a whole: its reason is the first of ``invalid_json``, ``shop_id_required``,
``events_count`` (not 1..100), then the reason of its first failing event by position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EVENT_TYPES, MAX_EVENT_AGE_HOURS

# RFC 3339 date-time: full date, 'T', time with optional fraction, 'Z' or numeric offset.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def parse_rfc3339(s) -> Column:
    """Timestamp of an RFC 3339 string; NULL when not RFC 3339 (Spark's own cast is more
    lenient: it takes a bare date or a blank instead of 'T', hence the regex guard)."""
    s = F.col(s) if isinstance(s, str) else s
    return F.when(s.rlike(RFC3339), s.try_cast("timestamp"))


def event_reason(session_id, event_type, ts_text, ingest_ts) -> Column:
    sid = F.col(session_id) if isinstance(session_id, str) else session_id
    et = F.col(event_type) if isinstance(event_type, str) else event_type
    t = F.col(ts_text) if isinstance(ts_text, str) else ts_text
    ing = F.col(ingest_ts) if isinstance(ingest_ts, str) else ingest_ts
    parsed = parse_rfc3339(t)
    present = t.isNotNull() & (t != "")
    return (F.when(sid.isNull() | (sid == ""), F.lit("session_id_required"))
             .when(et.isNull() | ~et.isin(*EVENT_TYPES), F.lit("invalid_type"))
             .when(present & parsed.isNull(), F.lit("invalid_timestamp"))
             .when(present & late(parsed, ing), F.lit("too_old")))


def late(event_ts: Column, ingest_ts: Column, hours: int = MAX_EVENT_AGE_HOURS) -> Column:
    """Late-data gate: strictly older than ingest - 24 h. A per-row predicate, not a
    watermark: it does not depend on other rows."""
    return event_ts < ingest_ts - F.expr(f"INTERVAL {hours} HOURS")


def default_timestamp(ts_text, ingest_ts) -> Column:
    """Event time, or the ingest time when missing or unparsable."""
    t = F.col(ts_text) if isinstance(ts_text, str) else ts_text
    ing = F.col(ingest_ts) if isinstance(ingest_ts, str) else ingest_ts
    return F.coalesce(parse_rfc3339(t), ing)
