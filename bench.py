"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
Every query is executed whole (no-op sink), best of two runs after one warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from cohortry.plans import queries
from cohortry.session import local_session

HEADLINE = [
    "return_rates", "link_window", "link_window_open", "link_asof_forward", "anchor_window", "prior_visits", "next_visit",
    "closest_to_anchor", "priority_pick", "strata_stats", "impute_normal", "lab_line", "lab_group_text", "clean_comment",
    "panel_text", "history_block", "assign_panel", "split_stratified", "balance_oversample", "embed_text", "top_k_similar",
    "combine_wide", "mask_random", "auroc", "ece", "mutual_information", "profile_columns", "cooccurrence", "resistance_matrix",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    build = queries()
    build["rate_by"](spark, folder).write.format("noop").mode("overwrite").save()
    spent: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            begin = time.perf_counter()
            build[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        spent[name] = round(min(runs), 3)
    spark.stop()
    total = round(sum(spent.values()), 3)
    sf = os.path.basename(folder).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": spent, "sf": sf}))


if __name__ == "__main__":
    main()
