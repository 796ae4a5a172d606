"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
Every query is computed in full into Spark's no-op sink, after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from specloom.plans import QUERIES
from specloom.session import build_session

HEADLINE = [
    "bm25_topk", "dense_topk", "hybrid_rrf", "fused_search_exact", "retrieval_recall_mrr", "retrieval_ndcg",
    "graph_expand_two_hops", "supersession_chains", "derived_supersession", "review_applied_corpus", "consolidated_corpus",
    "citations_with_spans", "resolved_citations", "lint_summary", "acceptance_rates", "feedback_labels",
    "windowed_actions", "user_sessions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    QUERIES["candidate_pool_depth"](spark, folder).collect()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
