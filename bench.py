"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores; ``BENCH_QUERIES`` may name
other queries (comma-separated, or ``all``). Every query is timed once, in the order given, from
building its plan to its last row; ``index_build`` comes first and is reused as it would be in use.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from evidence_engine.plans.queries import QUERIES  # noqa: E402
from evidence_engine.sources import driver_tables  # noqa: E402

HEADLINE = (
    "normalize_text",
    "chunk_documents",
    "tokenize",
    "term_frequency",
    "document_frequency",
    "hash_embed",
    "bm25_topk",
    "dense_topk",
    "dense_topk_external",
    "hybrid_search",
    "strategy_search",
    "answer_queries",
    "ingest_documents",
    "eval_metrics",
    "replace_document",
    "search_after_changes",
    "chunk_ablation",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()

    seconds = {}
    start = time.perf_counter()
    driver_tables.corpus_index(spark, sf_dir)
    seconds["index_build"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
