"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from wattframe.plans.catalog import catalog  # noqa: E402
from wattframe.session import build_session  # noqa: E402

HEADLINE = (
    "a1_energy_by_region_fueltech_1d",
    "a1_energy_by_region_fueltech_1h",
    "a3_market_metrics_region_1d",
    "a7_unit_daily",
    "a12_market_daily",
    "a32_wide_export",
    "d1_latest_version",
    "e1_trapezoid_energy",
    "e2_unit_intervals",
    "e5_market_summary",
    "f4_flow_emissions",
    "f5_flow_emissions_mix",
    "g2_locf",
    "g4_interpolate",
    "j6_value_at",
    "n2_split_bidirectional",
    "q1_frozen_telemetry",
    "r1_detect_records_day",
    "r1_find_records",
    "s1_report_unit_scada",
    "s17_upsert_replace",
    "st4_upsert_last",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog()
    # One small query first, so that starting up is not charged to any.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
