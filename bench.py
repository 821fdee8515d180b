"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced through the ``noop`` sink (full execution, nothing
collected) and timed; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicspark.plans.registry import all_queries  # noqa: E402
from topicspark.session import get_spark  # noqa: E402

HEADLINE = [
    "word_freq_doc",        # T1-T3: tokenise, stop words, per-document counts
    "daily_word_long",      # T4-T9: clean, lemmatise, count, daily long table
    "knn_exact",            # E2: blocked exact top-k
    "seq_cluster",          # C1: kNN lists + rank-peel greedy clustering
    "l1_doc_loading",       # flagship: text -> vectors -> clusters -> L1 loadings
    "lsa_singular_values",  # F5-F10: per-cluster truncated SVD by subspace iteration
    "lda_importance",       # F11-F19: batched EM, 10 topics, 15 passes
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app_name="topicspark-bench",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="topicspark-bench-")})
    qs = all_queries()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 2)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 2),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir}))


if __name__ == "__main__":
    main()
