"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.
Every query runs to completion (the noop sink forces all rows).  An untimed
warm-up pass runs every headline query once on the tiny sf0.001 tables, so
JIT compilation and Python worker start-up are not charged to the first
timed query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "paragraph_coherence",          # embed + blocked lag + aggregate (source corpus)
    "section_contrast",             # exact pair statistics, pairs + Gram paths
    "search_precision",             # sentence x query join, top-3, keyword hits
    "overall_score",                # the whole document evaluation, blended
    "paragraph_coherence_vectors",  # given vectors
    "section_contrast_vectors",     # Gram path on given vectors
    "paragraph_coherence_chats",
    "section_contrast_chats",
    "spearman_by_model",            # pair evaluation: similarity + average ranks
    "search_queries",               # strict parse + topic queries
    "search_precision_custom",      # a caller's query set in blocks
    "comparison_table",             # pair evaluation, embedded once
    "stream_ingest",                # the ingest over the documents table
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tessera.plans.registry import registry
    from tessera.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    reg = registry()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    def run(name, where=sf_dir):
        reg[name](spark, where).write.format("noop").mode("overwrite").save()

    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for n in names:
            run(n, warm_dir)
    times = {}
    for n in names:
        t0 = time.time()
        run(n)
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
