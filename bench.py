"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice and the better time counts: the first run of a JVM
mostly measures its warm-up.
"""

from __future__ import annotations

import json
import os
import time

from leaguelens.catalog import QUERIES
from leaguelens.session import local_session

HEADLINES = [
    "w2_trailing_mean",
    "w7_forward_fill",
    "j9_asof_carry",
    "a9_dist_summary",
    "g1_build_entity_fact",
    "g3_entity_features",
    "g4_team_features",
    "g8_matchup_totals",
    "g9_sequential_rating",
    "g13_bootstrap_outcomes",
    "g14_summarize_outcomes",
    "g16_best_selection",
    "r3_mart_residuals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8)
    times = {}
    for name in HEADLINES * 2:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took = round(time.perf_counter() - start, 3)
        times[name] = min(took, times.get(name, took))
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
