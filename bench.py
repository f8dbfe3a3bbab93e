"""Times the headline queries; prints one JSON line.

Each query runs once as a warm-up that is not counted, then RUNS times; its
figure is the mean.  A run writes to Spark's no-op sink, so all rows and columns
are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "ssb_q41", "star_join_rows", "filter_lt", "filter_conjunction", "count_filtered", "agg_sum_single", "agg_sum_composite", "agg_partial_final",
    "join_first_match", "join_semi", "compaction_position", "exclusive_scan", "duplicate_count", "hash_partition_histogram", "hash_bucket_counts", "union_all", "report_best",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from quarryline.plans.catalogue import QUERIES
    from quarryline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        each = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        times[name] = round(sum(each[1:]) / RUNS, 4)
    spark.stop()
    print(json.dumps({"metric": "sum of mean query seconds, warm-up discarded", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
