"""Headline bench: wall seconds per query, one JSON line on stdout.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name-prefix ...]

Each query runs once to warm up (code generation, file footers) and then ``BENCH_RUNS`` times; the
median counts. Results go to a noop sink, so all rows are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evalweave.functions.session import local_session  # noqa: E402
from evalweave.plans.registry import all_queries  # noqa: E402

HEADLINE = [
    "B4_few_shot_split",
    "C2_material_context",
    "D6_latest_rows",
    "D9_freeze_outcomes",
    "E1_private_leaks",
    "E4_contamination_rows",
    "E7_literal_leakage",
    "E8_evidence_inventory",
    "E10_section_rules",
    "F5_status_counts",
    "F6_paired_deltas",
    "F7_coverage_summary",
    "F8_negative_transfer",
    "F13_token_usage",
    "F15_artifact_summary",
    "F16_consistency_summary",
    "F19_disagreements",
    "F25_worklist",
    "G1_rule_support",
    "G3_lessons",
    "H1_eval_rows_first",
    "H2_flow_audit",
    "H5_eval_coverage",
    "H7_readiness",
    "I4_temporal_packs",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:]
    queries = all_queries()
    chosen = [q for q in queries if any(q.startswith(n) for n in names)] if names else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            start = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        took[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
