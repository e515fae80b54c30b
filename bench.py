"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to Spark's noop sink: each row and column is computed, nothing is collected.
A query's time is the median of three runs after one that warms it up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "upsert_update", "upsert_update_small_batch", "upsert_nothing", "upsert_condition", "upsert_multi_key", "upsert_map_key", "in_values_int", "in_values_subquery", "annotate_group_by", "truncated_group", "top_k",
    "partition_route_range", "partition_bucket_week", "partition_pruned_scan", "unique_violations_composite", "fk_violations", "select_related", "matview_snapshot_vs_refresh", "shadow_migrate",
]


def main() -> None:
    from tablewright.queries import QUERIES
    from tablewright.session import local_session

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    sf = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "cpus": cpus, "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
