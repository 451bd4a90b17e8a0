"""Time the headline queries and print one JSON line.

Every query is run to the end of its plan (a ``noop`` write); the first run warms it up and the
median of the following ones counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from gristmill.catalog import load  # noqa: E402

HEADLINE = [
    "tag_filter",
    "exact_dedup",
    "p1_split",
    "split_counts_report",
    "curate_documents",
    "quality_filter",
    "length_filter",
    "forbidden_patterns",
    "allowed_patterns",
    "reject_reasons_report",
    "min_quality",
    "validate_orders",
    "validate_customer",
    "constraint_failures",
    "violations_by_rule_report",
    "validate_event_props",
    "v18_validate_text",
    "best_of_n",
    "training_text_pairs",
    "f4_tokenize",
    "gate_accepted",
    "gate_quarantine",
    "quality_report_orders",
    "v18_mutated_events",
    "g6_report_many_errors",
    "q8_json_quality_filter",
    "s2_jsonl_scan",
    "curate_corpus_files",
    "g4_stream_gate",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(run, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    registered = load().QUERIES
    timed = {}
    for name in HEADLINE:
        seconds(registered[name], spark, sf_dir)
        timed[name] = round(
            statistics.median(seconds(registered[name], spark, sf_dir) for _ in range(runs)), 3
        )
    spark.stop()
    line = {
        "metric": "total_seconds",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
