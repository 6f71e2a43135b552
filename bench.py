"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local threads,
``BENCH_ONLY`` an optional comma-separated list of query-name prefixes.
"""

from __future__ import annotations

import json
import os
import re
import time

from slabmill.catalog import queries
from slabmill.catalog.market import forget
from slabmill.session import build_session

HEADLINE = [
    "d01_build_pairs",
    "d02_repeat_sales_index",
    "d03_momentum_panel",
    "d04_liquidity_panel",
    "d05_factor_panel",
    "d06_catalyst_scores",
    "d08_catalyst_series",
    "d09_hedonic_features",
    "d13_grading_ev",
    "d15_half_spread",
    "d16_fair_value",
    "d17_trade_targets",
    "d18_exit_signals",
    "d22_build_portfolio",
    "d34_unified_cohort",
    "d38_stardom_premium",
    "d41_consensus_as_of",
    "d42_parse_pending",
    "d43_materialize_identities",
    "d46_import_counts",
    "d47_injury_events",
    "d48_playoff_events",
    "d55_rebalance_targets",
    "j07_asof_population",
    "j13_resolve_names",
    "j20_comparable_pairs",
    "r16_capture_targets",
    "r17_player_radar",
    "w08_locf_daily_spine",
    "st04_stream_weekly_medians",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else None)
    spark.range(1000).selectExpr("sum(id)").collect()
    known, times = queries(), {}
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only):
            continue
        forget()  # each query pays for all it needs
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
