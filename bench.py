"""Headline queries, timed: one JSON line on standard output.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
threads of the local session.  Each query is run once to warm up and then timed
as the median of three runs into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from textloom.plans import catalog
from textloom.session import local_session

HEADLINE = (
    "chunk_fixed",
    "clean_page",
    "sentence_group",
    "extract_paragraphs",
    "paragraphize",
    "dense_records",
    "sparse_records",
    "metadata_flatten",
    "dense_topk",
    "sparse_topk",
    "hybrid_search",
    "rerank_topn",
    "context_build",
    "rag_flagship",
    "highlight",
    "feedback_group_metrics",
    "best_model",
    "rate_by_label",
    "histogram_quantile",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    found = catalog.queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 4)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "sum of the headline queries' median seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
