"""Time the headline queries (or, with --all, every registered one) and print one JSON line.

Each query runs once untimed (class loading, code generation, JIT) and three times timed, of which the
median counts; BENCH_COLD=1 runs it once, timed. Results are written to the ``noop`` sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from evalspark.plans.registry import QUERIES
from evalspark.session import local_session

HEADLINE = (
    "accuracy_by_model", "accuracy_by_model_lines", "grade_lenient_lines", "subgroup_accuracy_lines",
    "grade_with_missing", "rescore_diff", "shared_accuracy", "final_responses", "pending_work", "queue",
    "cost_by_model", "catalog_violations", "shortcut_audit_planted", "association_planted", "candidate_grid",
    "level_coverage", "duplicate_contents", "match_audit", "field_mismatches", "frozen_overlaps",
    "dataset_fingerprint", "stream_grades", "stream_first_success", "subgroup_accuracy", "lenient_replies",
    "model_states", "catalog_documents", "stream_progress",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, **{"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if "--all" in sys.argv else [a for a in sys.argv[1:] if a in QUERIES] or HEADLINE

    def run(name: str) -> None:
        QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()

    cold = os.environ.get("BENCH_COLD") == "1"
    times: dict[str, float] = {}
    for name in names:
        if not cold:
            run(name)
        took = []
        for _ in range(1 if cold else 3):
            start = time.perf_counter()
            run(name)
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall-clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
