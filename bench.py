"""Time the headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from catalog.entries import QUERIES
from reachmap.session import local_session

HEADLINE = (
    "page_text", "page_links", "url_resolve", "email_all", "phone_all", "phone_region_filter", "response_reason",
    "body_truncate", "site_contacts", "site_lists", "crawl_reach", "site_results", "site_diagnostics", "options_validate",
    "mask_map", "log_latest", "stream_pages_dedupe", "stream_site_contacts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(f"local[{cpus}]", "bench", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/pages.parquet").count()  # start the JVM's readers before the clock
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
