"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is
built and run once to warm up, then twice, and its best time counts; results
go to a sink that drops the rows after computing all of them."""

from __future__ import annotations

import json
import os
import tempfile
import time

from ticketlens.operators import reports
from ticketlens.plans import catalog
from ticketlens.session import build_session
from ticketlens.sources.sinks import by_entry_month, full_refresh, shared_folder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
# From the raw tables to the result.
FROM_SOURCE = (
    "ticket_snapshot_active",
    "ticket_snapshot_closed",
    "stay_totals",
    "tracking_active",
    "tracking_closed",
    "unified_download_month",
    "volumetry",
    "volumetry_by_user",
    "mean_handling_time",
    "activity_list",
    "activity_state",
)
# On the stored tracking table, as the reports are used.
ON_STORED = {
    "stored_unified_download": lambda t: reports.unified_download(t, catalog.YEAR, mes=catalog.MONTH),
    "stored_volumetry": lambda t: reports.volumetry(t, catalog.REPORT_DAY),
    "stored_volumetry_by_user": lambda t: reports.volumetry_by_user(t, catalog.REPORT_DAY),
    "stored_mean_handling_time": lambda t: reports.mean_handling_time(t, catalog.REPORT_DAY),
}


RUNS = 2


def seconds(build) -> float:
    """Best time of building a query and computing all its rows, after a warm-up."""
    times = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(min(times[1:]), 3)


def main() -> None:
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        f"local[{CPUS}]", int(CPUS), **{"spark.driver.memory": "16g", "spark.checkpoint.dir": shared}
    )
    timings = {
        name: seconds(lambda query=catalog.QUERIES[name]: query(spark, SF_DIR)) for name in FROM_SOURCE
    }
    start = time.perf_counter()
    path = full_refresh(
        by_entry_month(catalog._unified(spark, SF_DIR)),
        shared_folder(spark, "bench"),
        ("mes_entrada",),
    )
    timings["full_refresh"] = round(time.perf_counter() - start, 3)
    stored = spark.read.parquet(path)
    for name, report in ON_STORED.items():
        timings[name] = seconds(lambda report=report: report(stored))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
