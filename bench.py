"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobsieve.registry import load  # noqa: E402
from jobsieve.session import session  # noqa: E402

HEADLINE = (
    "search_location", "min_salary", "latest_postings_topn", "top_locations", "salary_stats", "contact_methods",
    "export_stats", "job_family", "batch_numbers",
    "classify_strict", "found_date", "page_breakdown", "ending_patterns", "dedup_links", "until_empty3",
    "page_links", "page_title_text", "city_listing",
    "extract_core", "extract_email", "extract_contacts", "extract_description", "extract_requirements",
    "extract_postings", "extract_full_records", "tag_skills", "details_map", "emails_in_documents",
    "filter_new", "flag_seen", "upsert_seen", "sightings",
    "csv_roundtrip", "append_export", "stream_dedup", "stream_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "jobsieve.spread": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["top_locations"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
