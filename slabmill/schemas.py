"""Declared schemas, keys and partitions of the warehouse tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]
    partitions: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        """Parsed on use, because the parser needs a running session."""
        return StructType.fromDDL(self.ddl)


TABLES: dict[str, Table] = {
    "player_master": Table("player_id int, name string, br_slug string, team string, position string, draft_year int, draft_pick int, dob date, created_at timestamp", ("br_slug",)),
    "card_master": Table(
        "card_id bigint, player_id int, card_year int, manufacturer string, set_name string, card_number string, parallel string, print_run int, "
        "is_rookie boolean, has_auto boolean, has_patch boolean, is_one_of_one boolean",
        ("card_year", "manufacturer", "set_name", "card_number", "parallel"),
    ),
    "card_spec_map": Table("spec_id string, card_id bigint", ("spec_id",)),
    "tx_raw": Table(
        "raw_id string, source string, raw_title string, raw_price decimal(14,2), raw_currency string, sold_at timestamp, external_id string, "
        "raw_json string, ingested_at timestamp",
        ("source", "external_id"),
        ("source",),
    ),
    "tx_clean": Table(
        "raw_id string, card_id bigint, slab_grader string, slab_grade decimal(4,1), cert_number string, price_usd decimal(14,2), sold_at timestamp, "
        "parser_confidence decimal(4,3), parser_method string, sold_month date",
        ("raw_id",),
        ("sold_month",),
    ),
    "parse_failures": Table("raw_id string, reason string", ("raw_id",)),
    "card_identity_candidates": Table(
        "raw_id string, canonical_key string, player_name string, manufacturer string, card_year int, set_name string, subset string, card_number string, "
        "parallel string, print_run int, is_rookie boolean, has_auto boolean, has_patch boolean, slab_grader string, slab_grade double, confidence double, "
        "needs_review boolean, evidence_json string",
        ("raw_id",),
    ),
    "player_events": Table("event_id bigint, player_id int, event_type string, event_date timestamp, event_payload string", ("player_id", "event_type", "event_date")),
    "pop_snapshots": Table("snapshot_date date, card_id bigint, grader string, grade double, pop_count bigint", ("snapshot_date", "card_id", "grader", "grade"), ("snapshot_date",)),
    "factor_panel": Table(
        "card_id bigint, as_of_date date, r30 decimal(12,6), r90 decimal(12,6), r365 decimal(12,6), cs_momentum_pct decimal(6,4), is_hyped boolean, "
        "sales_count_90d bigint, dollar_volume_90d decimal(18,2), bid_ask_proxy decimal(12,5), last_sale_recency_days int, liquidity_tier string",
        ("card_id", "as_of_date"),
        ("as_of_date",),
    ),
    "repeat_sales_index": Table(
        "period_start timestamp, sport string, bucket string, grade_tier string, era string, index_value decimal(14,4), n_pairs bigint, se decimal(12,5)",
        ("period_start", "sport", "bucket", "grade_tier", "era"),
        ("bucket", "era", "grade_tier"),
    ),
    "tx_mispricing": Table("tx_id string, model_version string, residual decimal(10,6), predicted_log_price decimal(10,6)", ("tx_id", "model_version"), ("model_version",)),
    "player_stardom_score": Table(
        "player_id int, draft_year int, model_version string, premium decimal(6,4), percentile_rank decimal(6,4), fit_at timestamp", ("player_id", "model_version"), ("model_version",)
    ),
    "prospect_forecast": Table(
        "br_slug string, name string, draft_year int, model_version string, as_of_date date, premium decimal(6,4), pairwise_score decimal(10,4), "
        "consensus_rank decimal(6,2), sources_count bigint, is_underclassman boolean, years_until_draft int, prior_league string, n_games_played int",
        ("br_slug", "draft_year", "model_version", "as_of_date"),
        ("as_of_date", "draft_year"),
    ),
    "grading_ev": Table(
        "card_id bigint, as_of_date date, grade_tier string, gem_rate decimal(6,4), p10_price decimal(14,2), p9_price decimal(14,2), cost_to_grade decimal(10,2), "
        "raw_price decimal(14,2), ev decimal(14,2), ev_per_dollar decimal(14,4), p10_pop bigint, sample_size bigint",
        ("card_id", "as_of_date", "grade_tier"),
        ("as_of_date",),
    ),
    "trade_targets": Table(
        "card_id bigint, as_of_date date, fair_value decimal(14,2), bid_max decimal(14,2), sell_target decimal(14,2), stop_loss decimal(14,2), "
        "confidence decimal(4,3), half_spread_pct decimal(6,4), liquidity_margin_pct decimal(6,4)",
        ("card_id", "as_of_date"),
        ("as_of_date",),
    ),
    "exit_signal": Table(
        "holding_id bigint, rule_triggered string, recommended_action string, as_of_date date, notes string, resolved_at timestamp",
        ("holding_id", "rule_triggered", "as_of_date"),
        ("as_of_date",),
    ),
    "portfolio_holdings": Table(
        "holding_id bigint, card_id bigint, acquired_at timestamp, acquired_cost_usd decimal(14,2), status string, sold_at timestamp, sold_proceeds_usd decimal(14,2), "
        "entry_factor_decile int, entry_liquidity_tier string",
        ("holding_id",),
    ),
    "portfolio_overrides": Table("card_id bigint, target_weight_pct double, reason string", ("card_id",)),
}
