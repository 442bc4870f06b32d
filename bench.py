"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_headline_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query runs to completion through the ``noop`` sink (all work done, no
rows pulled to the driver). A small warm-up job starts the JVM and the Python
workers first. Extra fields carry the reference harness's metrics (per-search
latency, relevance, diversity, rerank agreement) computed by our own queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "paper_projection", "paper_filter_counters", "corpus_stats", "category_distribution",
    "text_statistics", "sample_diverse", "hash_encode", "knn_exact", "knn_clustered",
    "similar_docs", "multi_model_topk", "search_full", "knn_filtered_post", "rerank",
    "batch_digest", "summary_rule", "cache_upsert", "latency_profile",
]
PROFILES = ["relevance_profile", "diversity_profile", "rerank_agreement"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from papyra.session import local_session
    from papyra.plans.catalog import load_all

    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    from papyra.plans import adapters
    reg = load_all()
    adapters.SPREAD_SCANS = spark.sparkContext.defaultParallelism     # the tables are single files of one split

    # warm-up on the smallest tables: each query's generated code and the
    # Python workers are ready before timing starts; those first runs are
    # reported as cold_on_smallest
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    errors: dict[str, str] = {}
    cold: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        try:
            reg[name][0](spark, warm_dir).write.format("noop").mode("overwrite").save()
            cold[name] = round(time.time() - t0, 3)
        except Exception as e:
            errors[f"warm-up {name}"] = repr(e)[:300]

    times: dict[str, float | None] = {}
    for name in HEADLINE:
        t0 = time.time()
        try:
            reg[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # keep going; report the failure
            times[name] = None
            errors[name] = repr(e)[:300]

    extra: dict[str, object] = {}
    try:
        from papyra.plans.q_search import queries_table
        n_queries = queries_table(spark, sf_dir).count()
        if times.get("search_full"):
            extra["search_queries"] = n_queries
            extra["mean_latency_ms_per_search"] = round(times["search_full"] * 1000.0 / max(n_queries, 1), 3)
            extra["searches_per_sec"] = round(n_queries / times["search_full"], 2)
        for name in PROFILES:
            row = reg[name][0](spark, sf_dir).collect()
            extra[name] = row[0].asDict() if row else None
    except Exception as e:
        errors["profiles"] = repr(e)[:300]

    ok = [v for v in times.values() if v is not None]
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_headline_sec", "value": round(sum(ok), 3), "unit": "sec",
           "queries": times, "sf": float(sf.group(1)) if sf else sf_dir, "cpus": cpus, "cold_on_smallest": cold, **extra}
    if errors:
        out["errors"] = errors
    print(json.dumps(out, default=str))
    spark.stop()


if __name__ == "__main__":
    main()
