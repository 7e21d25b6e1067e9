"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. A warm-up run, then the median of three."""

from __future__ import annotations

import json
import os
import statistics
import time

from trackloom.plans.queries import QUERIES
from trackloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "tracks", "spoof_incidents", "squawk_incidents", "incursion_incidents", "gap_incidents", "jamming_incidents", "coverage_map", "all_incidents", "air_picture_aircraft",
    "track_geometry", "speed_percentiles", "hourly_activity", "dedup_append", "tracks_incremental", "integrity_series", "track_resample",
]


def main() -> None:
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
