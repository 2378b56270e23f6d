"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  All
queries run once to warm up and are then timed; every row is computed and discarded.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

import workload
from radloom import build_session

HEADLINE = (
    "match_summary", "swap_fallback", "detect_updates", "merge_updated", "screen_rules", "job_status",
    "rejection_reasons", "apply_rejectors", "swap_patient_id", "deid_actions", "isolate_good", "update_chain",
    "dirs_default", "series_rollup", "flatten_props", "allocate_surrogates", "report_verification",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.log.level": "ERROR"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for _ in range(2):
        for name in names:
            start = time.perf_counter()
            workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
