"""Time the headline queries on the tables in $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom import build_session  # noqa: E402
from riskloom.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "pii_raw_counts",
    "pii_kept",
    "pii_doc_summary",
    "pii_presence_view",
    "pii_natural_sources",
    "pii_dedupe",
    "doc_score",
    "score_breakdown",
    "scan_stats",
    "scan_budget",
    "running_stats",
    "extract_text",
    "chat_documents",
    "whatsapp_messages",
    "telegram_messages",
    "table_text_dump",
    "audit_files",
    "rollup_grouping_sets",
    "top_n_others",
    "group_top_k_category",
    "dir_rollup",
    "search_directories",
    "dashboard_metrics",
    "redact_documents",
    "encrypt_roundtrip",
    "remediation_events",
    "ledger_stats",
    "ledger_append",
    "ner_entities",
    "stream_detections",
    "stream_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    # One untimed query starts the JVM's compilers and the Python workers.
    QUERIES["doc_score"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
