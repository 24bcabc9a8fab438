"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

each a full execution into the ``noop`` sink. Prints one JSON line.
BENCH_QUERIES=all runs every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p6_unified_events", "a1_errors_per_hour", "a2_attempts_per_ip", "a4_ip_features", "p7_attack_counters",
    "p9_text_alerts", "n7_first_ipv4", "d15_alarms", "d6_lof_vote", "d8_dbscan_noise", "d22_full_detector",
    "f1_forecast_by_source", "m4_content_ids", "m7_nearest3", "r4_action_router", "r9_blocked_add",
    "l7_kpi_record", "l8_four_hour_windows", "s13_j5_integrity_manifest", "u3_remembered_ips",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from lookout.plans.catalog import load_all
    from lookout.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    reg = load_all()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(reg) if wanted == "all" else ([n for n in wanted.split(",") if n] or HEADLINE)
    times, errors = {}, {}
    for name in names:
        try:
            def run():
                t0 = time.perf_counter()
                reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
                return time.perf_counter() - t0
            run()  # warm-up
            times[name] = round(statistics.median(run() for _ in range(repeat)), 3)
        except Exception as e:  # keep going, report it
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": int(cpus), "repeat": repeat}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
