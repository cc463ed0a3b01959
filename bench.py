"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs to the end into a sink that drops the rows.  The first query is
run once before, so its time is not the start of the JVM.  ``BENCH_QUERIES`` is an
optional comma list of names, ``all`` for every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from faultatlas.plans.catalog import QUERIES
from faultatlas.session import local_session

HEADLINE = [
    "parse_symbols",
    "resolved_imports",
    "resolved_calls",
    "graph_edges",
    "graph_stats",
    "file_dependencies",
    "impact_paths",
    "impact_summary",
    "blast_radius",
    "related_files",
    "data_flow",
    "circular_dependencies",
    "map_edges",
    "bandit_findings",
    "compiler_findings",
    "model_findings",
    "deduped_findings",
    "fixable_split",
    "finding_search",
    "enriched_findings",
    "memory_upsert",
    "similar_fixes",
    "plan_findings",
    "plan_items",
    "applied_edits",
    "patch_results",
    "gate_results",
    "security_diff",
    "selected_attempts",
    "approvals",
    "pr_records",
    "severity_distribution",
    "top_files",
    "live_metrics",
    "latest_feed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=max(8, int(cores)), memory="16g")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    run(names[0])
    seconds = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cores),
            }
        )
    )


if __name__ == "__main__":
    main()
