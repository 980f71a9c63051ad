"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contextquarry import catalog
from contextquarry.session import local_session

QUERIES = ("tokenize", "bm25_fielded", "bm25_topk", "supply_graph", "graph_contrib_d1", "pack_selected", "pack_totals", "recall_at_k", "sse_frames", "cost_projection", "quota_decisions", "request_admission")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    queries["edge_report"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first query also starts Spark
    for name in QUERIES:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
