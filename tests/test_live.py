"""Live buckets equal the batch buckets after every micro-batch, open ones among them."""

import datetime as dt
import uuid

from conftest import events_df
from test_incremental import some_events

from shoplens.plans import reports as R
from shoplens.session import checkpoint_root
from shoplens.streaming.live import LiveIntraday

DAY = dt.datetime(2026, 3, 20), dt.datetime(2026, 3, 21)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_buckets_are_live(spark):
    live = LiveIntraday(spark, f"{checkpoint_root(spark)}/live-{uuid.uuid4().hex}")
    events = some_events(7, n=150, days=2)  # in no order: cancels before purchases, late events
    for k in range(3):
        live.add(events_df(spark, events[k * 50:(k + 1) * 50]), "q", k)
        live.add(events_df(spark, events[k * 50:(k + 1) * 50]), "q", k)  # the micro-batch runs again
        bronze = events_df(spark, events[:(k + 1) * 50])
        if k != 1:
            assert rows(live.read(*DAY)) == rows(R.intraday_buckets(bronze, *DAY))
    assert rows(live.read(*DAY, per_shop=False)) == rows(R.intraday_buckets(bronze, *DAY, per_shop=False))
    assert rows(live.read(*DAY, shop_id="a")) == rows(R.intraday_buckets(bronze, *DAY, shop_id="a"))
    assert rows(live.read(*DAY, shop_id="idle")) == rows(R.intraday_buckets(bronze, *DAY, shop_id="idle"))
    before = rows(live.read(*DAY))
    for table in (live.pairs, live.orders, live.bought):
        table.compact(fan_in=2)
    assert rows(live.read(*DAY)) == before
    live.expire(dt.date(2026, 3, 21))
    assert all(r["page_views"] == 0 for r in live.read(*DAY, shop_id="a").collect())
