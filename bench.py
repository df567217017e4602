"""Headline queries: seconds each, as one JSON line.

Two kinds are timed. Queries over the derived relation build their logs from the order
lines every time. ``warehouse_*`` read a warehouse that is loaded once from an export of
the same logs, so predicates reach the files; loading is timed as ``load`` with its rows
a second. The total is that of the first kind.
"""

from __future__ import annotations

import json
import os
import time

from loghaven import registry, registry_store
from loghaven.operators.backfill import Backfill
from loghaven.session import build_session

HEADLINES = (
    "contract_provenance",
    "token_provenance",
    "erc1155_single_uri_mixed",
    "owner_scan_three_legs",
    "keep_shape_filter",
    "signature_counts",
    "stats_by_year_event",
    "stats_totals",
    "densest_block",
    "logless_blocks",
    "disagreeing_heights",
    "write_range_replace",
    "dense_block_receipts",
)
WAREHOUSE = ("store_contract", "store_token", "store_owner", "store_erc1155", "store_block_by_hash", "eth_get_logs", "store_rewind", "store_write_range")


def _seconds(spark, query, path: str) -> float:
    begun = time.perf_counter()
    query(spark, path).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begun, 3)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"), spark__sql__shuffle__partitions=os.environ.get("BENCH_CPUS", "8"), spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, stored = registry.queries(), registry_store.queries()
    _seconds(spark, queries[HEADLINES[0]], path)  # compile once
    seconds = {name: _seconds(spark, queries[name], path) for name in HEADLINES}
    total = round(sum(seconds.values()), 3)

    rig = registry_store.rig(spark, path)
    rows = rig.raw.count()
    export = rig.export
    begun = time.perf_counter()
    loaded = rig.empty()
    Backfill(loaded, export).run()
    load = time.perf_counter() - begun
    rig.__dict__["store"] = loaded
    kept = loaded.latest().frame("logs").count()
    seconds |= {f"warehouse_{name.removeprefix('store_')}": _seconds(spark, stored[name], path) for name in WAREHOUSE}
    seconds["load"] = round(load, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(path.rstrip("/")), "load_rows_per_sec": round(kept / load), "source_rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
