"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and is then timed once. Result rows are counted through a no-op sink, so nothing is
collected. Two throughput figures sit next to the times: log records per second through the whole parse, and events per
second through bounded de-duplication.
"""

from __future__ import annotations

import json
import os
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "frame_lines", "assemble_records", "dispatch_rules", "captured_signals", "validate_events", "parse_rendered_log",
    "dedupe_bounded", "environment_timeline", "profile_selection", "asof_by_key", "sequence_match", "target_transitions",
    "match_purchases", "server_sessions", "inventory_context", "unknown_buckets", "facet_counts", "late_filter",
    "lifecycle_state", "connection_state", "query_page", "activity_feed", "render_messages", "redact_text", "privacy_scan",
    "ledger_apply", "blueprint_catalogue", "stream_dedupe",
]


def main() -> None:
    from tracewright.session import local_session
    from tracewright.workload import load

    spark = local_session(CPUS, "bench")
    queries, _ = load()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times: dict[str, float] = {}
    for name in names:
        for timed in (False, True):
            start = time.perf_counter()
            queries[name](spark, SF).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    rates = {
        f"{label}_per_sec": round(events / times[q])
        for label, q in (("parse_records", "parse_rendered_log"), ("dedupe_events", "dedupe_bounded"))
        if q in times
    }
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), **rates}
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
