"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fairlead.catalog import QUERIES  # noqa: E402
from fairlead.session import build_session  # noqa: E402

HEADLINE = (
    "host_top_links", "canonical_url", "links", "sentences", "text_bound", "derive_status", "link_score", "dedup", "geo_match",
    "concept_match", "interval_union", "search_merge", "arrival_cap", "topk", "change_track", "state_fold", "ledger", "retry_set",
    "query_plan", "page_text", "identity_facts", "evidence", "page_shape", "eligibility_facts", "eligibility", "value_level", "digest_rank",
    "outbox_items", "two_hop",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.sql.shuffle.partitions": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("canonical_url", "sentences"):  # start the JVM's compiler and the Python workers before timing
        QUERIES[name](spark, sf_dir).limit(10).collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}))


if __name__ == "__main__":
    main()
