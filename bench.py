"""Seconds per headline query: prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores,
BENCH_QUERIES a comma list of queries, or "all".
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from lexloom.plans import catalog
from lexloom.session import local_session

HEADLINE = [
    "keyword_search",
    "keyword_retry",
    "vector_search",
    "hybrid_search",
    "chunks",
    "quantize",
    "segments",
    "clauses",
    "footnote_asof",
    "status_counts",
    "citations",
    "line_classes",
    "crosscheck_jaccard",
    "page_text",
    "page_changes",
    "change_flags",
    "prose_lint",
    "readability",
    "script_audit",
    "script_repair",
    "fuse_quality",
    "embed_hash",
    "tokens",
    "schema_errors",
    "resolve_refs",
    "dedupe_first",
    "duplicate_keys",
    "prev_next",
    "siblings",
    "timeline",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared}
    spark = local_session(cpus, "bench", **conf)
    spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
