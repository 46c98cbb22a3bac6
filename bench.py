"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full into Spark's no-op sink (every row computed,
nothing collected). Every query is first run once on sf0.001 (not timed) so
JVM code generation, JIT and Python worker start-up are not charged to the
first timed query of each kind. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "chunk_words", "markdown_elements", "chunk_union", "hash_embed", "knn_sparse", "metric_context",
    "metric_candidates", "extract_metrics", "doc_summary", "knn_cosine", "knn_l2", "knn_per_document",
    "response_parse", "result_rows", "report_rollup", "metric_trend", "validation_report",
    "stream_chunks", "document_answers", "vector_search", "chunk_words_blocks",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from docmetrics.plans.queries import QUERIES
    from docmetrics.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    # Warm the JVM and the Python workers on the smallest data (not timed).
    small = "/root/testdata/sf0.001"
    names = only or HEADLINE
    if os.path.isdir(small):
        for name in names:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sfv = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sfv}))


if __name__ == "__main__":
    main()
