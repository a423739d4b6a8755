"""Run the headline queries and print one JSON line.

Each query is planned and run to completion with a sink that discards rows, so no result passes
through the driver.
"""

from __future__ import annotations

import json
import os
import time

from agentcorpus import catalogue
from agentcorpus.session import local_session

HEADLINE = (
    "audit_pages",
    "audit",
    "assign_destination",
    "unit_split_audit",
    "leakage_audit",
    "website_catalog",
    "unit_capped_pool",
    "temperature_sample",
    "diverse_sample",
    "natural_sample",
    "explode_trajectory",
    "qa_score",
    "grounding_summary",
    "action_summary",
    "score_mixed",
    "shard_coverage",
    "materialize_manifest",
    "completion_issues",
    "scaling_gate",
    "pair_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "agentcorpus-bench")
    queries, _ = catalogue.load()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
