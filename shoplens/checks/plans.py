"""Physical-plan summary of the main views and reports (plan review tool).

    python -m shoplens.checks.plans [--sf /root/testdata/sf0.01]

Bronze is first written as a month-partitioned table (as in production), then each plan
is built over it and summarised: exchanges (shuffles and their keys), join strategies,
aggregate operators, top-k operators and the filters pushed into the Parquet scan.
"""

from __future__ import annotations

import argparse
import re
import sys


def summarize(df) -> dict:
    p = df._jdf.queryExecution().executedPlan().toString()
    ops = re.findall(r"^[\s+:\-]*([A-Z][A-Za-z]+)", p, re.M)
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", p)
    keys = sorted({", ".join(re.sub(r"#\d+L?", "", k) for k in s.split(", ")) for s in shuffles})
    pushed = sorted({re.sub(r"#\d+L?", "", x)[:160] for x in re.findall(r"PushedFilters: \[(.*?), ReadSchema", p)})
    parts = sorted({re.sub(r"#\d+L?", "", x)[:160] for x in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", p)})
    return {
        "shuffles": len(shuffles),
        "shuffle_keys": keys,
        "broadcasts": ops.count("BroadcastExchange"),
        "joins": sorted({o for o in ops if o.endswith("Join")}),
        "aggregates": {o: ops.count(o) for o in ("HashAggregate", "ObjectHashAggregate", "SortAggregate") if o in ops},
        "topk": sorted({o for o in ops if o in ("WindowGroupLimit", "TakeOrderedAndProject")}),
        "expand": "Expand" in ops,
        "partition_filters": [x for x in parts if x][:2],
        "pushed_filters": pushed[:3],
    }


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    a = ap.parse_args(argv)
    sys.path.insert(0, ".")
    from shoplens.plans import reports as R
    from shoplens.plans import views as V
    from shoplens.session import build_session, checkpoint_root
    from shoplens.sources import bronze as BR
    from shoplens.sources.bridge import EVENTS_AS_OF, events_bronze

    spark = build_session()
    path = f"{checkpoint_root(spark)}/plans-bronze"
    BR.write(events_bronze(spark, a.sf), path, mode="overwrite")
    b = BR.read(spark, path)
    v = V.all_views(b, EVENTS_AS_OF)
    w30, w7 = R.window("30d", EVENTS_AS_OF), R.window("7d", EVENTS_AS_OF)
    items = dict(v)
    items.update({
        "kpi_windows": R.kpi_windows(v["dashboard_kpi"], "7d", EVENTS_AS_OF),
        "intraday_buckets": R.intraday_buckets(b, *R.window("24h", EVENTS_AS_OF)),
        "top_pages": R.top_pages(b, w30),
        "returning_customers": R.returning_customers(b, w7),
        "by_location": R.by_location(v["daily_geo"], w30),
        "bronze_scan": BR.scan(b, w7[0], w7[1], shop_id="shop_1", event_types=("purchase",)),
    })
    for name, df in items.items():
        s = summarize(df)
        print(f"### {name}")
        for k, val in s.items():
            print(f"- {k}: {val}")
        print()
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
