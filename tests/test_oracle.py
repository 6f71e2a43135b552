"""Queries against their SQL twins. ``SLABMILL_ORACLE=all`` checks every one of them."""

from __future__ import annotations

import os

import pytest

from slabmill.catalog import oracle_sql, queries
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()
CORE = [
    "a15_pair_statistics", "d01_build_pairs", "d04_liquidity_panel", "d05_factor_panel", "d07_catalyst_change", "d08_catalyst_series",
    "d09_hedonic_features", "d13_grading_ev_trend", "d17_trade_targets", "d18_exit_signals", "d22_build_portfolio", "d23_tactical_tilt",
    "d34_unified_cohort", "d38_stardom_premium", "d42_parse_pending", "d43_materialize_identities", "d46_import_counts",
    "d47_injury_events", "d48_playoff_events", "d50_transaction_events", "d55_rebalance_targets", "j07_asof_population", "j13_resolve_names",
    "j20_comparable_pairs", "k02_upsert", "r16_capture_targets", "r17_player_radar", "s10_explode_html_rows", "st01_stream_parse",
    "st03_stream_status_changes", "st04_stream_weekly_medians", "u05_grading_overlay", "w06_volume_weighted_returns", "w09_trailing_volume",
]
CHECKED = sorted(SQL) if os.environ.get("SLABMILL_ORACLE") == "all" else CORE


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql_twin(spark, duck, name):
    assert compare(queries()[name](spark, FOLDER), duck, SQL[name]) is None


def test_every_query_without_twin_is_known():
    assert set(queries()) - set(SQL) == {
        "d02_repeat_sales_index",
        "d02_repeat_sales_index_monthly",
        "d10_hedonic_predictions",
        "d17_trade_targets_repeat_sales",
        "d37_holdout_concordance",
        "d37_pairwise_ranker",
    }
