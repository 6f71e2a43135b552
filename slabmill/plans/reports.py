"""Read-only report queries over the market and derived tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabmill.functions import money, sale_text
from slabmill.operators.ordering import exact_quantiles
from slabmill.plans.parsing import search_query

TIER_ORDER = {"A": 0, "B": 1, "C": 2, "D": 3}
ACTION_ORDER = {"review_identity": 0, "ingest_more": 1, "covered": 2}


def custom_order(value: Column, order: dict[str, int], other: int = 9) -> Column:
    table = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), F.lit(other))


def at_latest(df: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Rows of the newest snapshot; the date is a scalar subquery, so partitions prune."""
    return df.where(F.col(date) == df.agg(F.max(date).alias("d")).scalar())


def index_series(index: DataFrame) -> DataFrame:
    return index.where(F.col("index_value").isNotNull()).select(
        F.col("period_start").alias("as_of"), F.concat_ws("/", "era", "grade_tier").alias("sleeve"), "index_value"
    )


def residual_detail(residuals: DataFrame, tx: DataFrame, card: DataFrame, player: DataFrame) -> DataFrame:
    """Residual, sale, card and player side by side."""
    return (
        residuals.join(tx.select("tx_id", "card_id"), "tx_id")
        .join(card.select("card_id", "card_year", "set_name", "parallel", "player_id"), "card_id")
        .join(player.select("player_id", F.col("name").alias("player")), "player_id")
        .select(
            "tx_id", "residual", F.exp("predicted_log_price").alias("fair_value"), "card_year", "set_name", "parallel", "player"
        )
    )


def top_residuals(detail: DataFrame, n: int = 20, by: str = "undervalued") -> DataFrame:
    key = {"undervalued": F.col("residual").desc(), "overvalued": F.col("residual").asc(), "absolute": F.abs("residual").desc()}[by]
    return detail.orderBy(key, "tx_id").limit(n)


def stardom_board(scores: DataFrame, player: DataFrame, draft_year: int | None = None) -> DataFrame:
    wanted = scores if draft_year is None else scores.where(F.col("draft_year") == draft_year)
    joined = wanted.join(player.select("player_id", "name"), "player_id")
    return joined.select("player_id", "name", "draft_year", "premium", "percentile_rank").orderBy(F.col("premium").desc(), "player_id")


def latest_forward(forecast: DataFrame, draft_year: int | None = None) -> DataFrame:
    """Newest snapshot of one class (default: the latest class), best premium first."""
    year = forecast.agg(F.max("draft_year").alias("y")).scalar() if draft_year is None else F.lit(draft_year)
    cohort = forecast.where(F.col("draft_year") == year)
    return at_latest(cohort).orderBy(F.col("premium").desc_nulls_last(), "br_slug")


def player_price_history(tx: DataFrame, card: DataFrame, player_id: int) -> DataFrame:
    mine = card.where(F.col("player_id") == player_id).select("card_id")
    return tx.where(F.col("sold_at").isNotNull()).join(mine, "card_id", "left_semi").select("tx_id", "sold_at", "price_usd").orderBy("sold_at", "tx_id")


# --- identity ---------------------------------------------------------------------
def _status() -> Column:
    return F.coalesce(F.get_json_object("evidence_json", "$.review_status"), F.lit(""))


def identity_summary(candidates: DataFrame) -> DataFrame:
    rejected = _status() == "rejected"
    return candidates.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_distinct("canonical_key").alias("distinct_identities"),
        F.count_if("needs_review").alias("needs_review"),
        F.count_if(~F.col("needs_review") & ~rejected).alias("high_confidence"),
        F.count_if(rejected).alias("rejected"),
    )


def review_filter(candidates: DataFrame, needs_review: bool | None = None, include_rejected: bool = False) -> DataFrame:
    out = candidates if include_rejected else candidates.where(_status() != "rejected")
    return out if needs_review is None else out.where(F.col("needs_review") == needs_review)


def review_queue(candidates: DataFrame, raw: DataFrame, limit: int = 200, **filters) -> DataFrame:
    """Least certain candidates first; raw rows are joined for the shown page only."""
    page = review_filter(candidates, **filters).orderBy(F.col("needs_review").desc(), "confidence", F.col("raw_id").desc()).limit(limit)
    query = F.get_json_object("evidence_json", "$.search_query").alias("search_query")
    return page.select("*", query).join(raw.select("raw_id", "raw_title", "raw_price", "sold_at"), "raw_id").drop("evidence_json")


ROLLUP_KEYS = [
    "canonical_key", "player_name", "manufacturer", "card_year", "set_name", "subset", "card_number", "parallel", "print_run",
    "slab_grader", "slab_grade",
]


def identity_rollup(candidates: DataFrame, limit: int | None = 200) -> DataFrame:
    out = candidates.groupBy(*ROLLUP_KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("needs_review").alias("review_rows"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
    )
    if limit is None:
        return out
    return out.orderBy(F.col("n_rows").desc(), "canonical_key", F.col("slab_grader").asc_nulls_first(), F.col("slab_grade").asc_nulls_first()).limit(limit)


# --- panels, events -------------------------------------------------------------------
def latest_panel(panel: DataFrame, card: DataFrame, player: DataFrame) -> DataFrame:
    return (
        at_latest(panel)
        .join(card.select("card_id", "card_year", "set_name", "parallel", "player_id"), "card_id")
        .join(player.select("player_id", F.col("name").alias("player")), "player_id")
        .drop("player_id")
        .orderBy(F.col("cs_momentum_pct").desc_nulls_last(), "card_id")
    )


def top_catalysts(scores: DataFrame, player: DataFrame, limit: int = 10) -> DataFrame:
    named = scores.join(player.select("player_id", F.col("name").alias("player_name")), "player_id", "left")
    return named.select("player_id", F.coalesce("player_name", F.lit("")).alias("player_name"), "catalyst_score").orderBy(
        F.abs("catalyst_score").desc(), "player_id"
    ).limit(limit)


# --- health and capture ------------------------------------------------------------------
def raw_vs_clean(raw: DataFrame, clean: DataFrame, limit: int | None = 30) -> DataFrame:
    """Raw and cleaned rows per ingest day and source."""
    marked = raw.select("raw_id", "source", F.to_date("ingested_at").alias("day")).join(
        clean.select("raw_id", F.lit(1).alias("_c")), "raw_id", "left"
    )
    out = marked.groupBy("day", "source").agg(F.count(F.lit(1)).alias("raw_count"), F.count("_c").alias("clean_count"))
    return out if limit is None else out.orderBy(F.col("day").desc(), "source").limit(limit)


def warehouse_counters(raw: DataFrame, clean: DataFrame, failures: DataFrame, captured: str = sale_text.SOURCE) -> DataFrame:
    clean_rows, failed_rows = (d.agg(F.count(F.lit(1)).alias("n")).scalar() for d in (clean, failures))
    return raw.agg(
        F.count(F.lit(1)).alias("raw_transactions"), F.count_if(F.col("source") == captured).alias("captured_rows")
    ).select("raw_transactions", clean_rows.alias("clean_transactions"), "captured_rows", failed_rows.alias("parse_failures"))


def coverage(raw: DataFrame, source: str | None = sale_text.SOURCE) -> DataFrame:
    """Rows and last ingest per search basket."""
    mine = raw if source is None else raw.where(F.col("source") == source)
    return mine.groupBy(search_query(F.col("raw_json")).alias("search_query")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("ingested_at").alias("latest_ingested_at")
    )


def capture_targets(queue: DataFrame, covered: DataFrame, candidates: DataFrame, limit: int | None = 50) -> DataFrame:
    """What to capture or review next per queued search (tier, search_query, target_rows, cadence)."""
    query = F.get_json_object("evidence_json", "$.search_query")
    review = candidates.where(F.coalesce(query, F.lit("")) != "").groupBy(query.alias("search_query")).agg(
        F.count_if("needs_review").alias("needs_review_rows")
    )
    have, target = F.coalesce("n_rows", F.lit(0)), F.col("target_rows")
    out = queue.join(covered, "search_query", "left").join(review, "search_query", "left").select(
        "tier",
        "search_query",
        sale_text.search_url(F.col("search_query")).alias("url"),
        have.alias("n_rows"),
        "target_rows",
        F.greatest(target - have, F.lit(0)).alias("remaining_rows"),
        F.when(target == 0, 0.0).otherwise(have / target * 100).alias("coverage_pct"),
        F.coalesce("needs_review_rows", F.lit(0)).alias("needs_review_rows"),
        "cadence",
        "latest_ingested_at",
    )
    action = F.when(F.col("needs_review_rows") > 0, "review_identity").when(F.col("remaining_rows") > 0, "ingest_more").otherwise("covered")
    out = out.withColumn("next_action", action)
    if limit is None:
        return out
    order = [custom_order(F.col("next_action"), ACTION_ORDER), custom_order(F.col("tier"), TIER_ORDER)]
    return out.orderBy(*order, "coverage_pct", "n_rows", "search_query").limit(limit)


def next_capture_plan(queue: DataFrame, covered: DataFrame, limit: int = 10) -> DataFrame:
    """Under-covered searches, best tier and emptiest first."""
    have = F.coalesce("n_rows", F.lit(0))
    short = queue.join(covered.select("search_query", "n_rows"), "search_query", "left").withColumn("current_rows", have).where(
        F.col("current_rows") < F.col("target_rows")
    )
    return short.select(
        "tier", "search_query", "current_rows", "target_rows", (F.col("target_rows") - F.col("current_rows")).alias("remaining_rows"),
        "cadence", sale_text.search_url(F.col("search_query")).alias("url"),
    ).orderBy(custom_order(F.col("tier"), TIER_ORDER), F.col("current_rows") / F.col("target_rows"), "search_query").limit(limit)


def basket_stats(raw: DataFrame, source: str | None = sale_text.SOURCE) -> DataFrame:
    """Price statistics per search basket and the share of sales at twice the median or more."""
    mine = raw if source is None else raw.where(F.col("source") == source)
    priced = mine.select(search_query(F.col("raw_json")).alias("search_query"), F.col("raw_price").cast("double").alias("p"), "sold_at", "ingested_at")
    priced = priced.where((F.col("search_query") != "unknown") & F.col("p").isNotNull())
    stats = priced.groupBy("search_query").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("p").alias("avg_price"), F.max("p").alias("high_sale"), F.min("p").alias("low_sale"),
        F.stddev_samp("p").alias("price_std"), F.max("sold_at").alias("latest_sale_at"), F.max("ingested_at").alias("latest_ingested_at"),
    )
    med = exact_quantiles(priced, ["search_query"], "p", {"median_price": 0.5})
    # Distinct prices carry their counts, so the comparison with the median joins
    # price levels instead of sales.
    levels = priced.groupBy("search_query", "p").agg(F.count(F.lit(1)).alias("n"))
    high = (F.col("median_price") > 0) & (F.col("p") >= 2 * F.col("median_price"))
    premium = levels.join(med, "search_query").groupBy("search_query").agg(
        (F.sum(F.when(high, F.col("n")).otherwise(0)) / F.sum("n")).alias("premium_sale_pct")
    )
    return stats.join(med, "search_query").join(premium, "search_query")


def player_radar(queue: DataFrame, stats: DataFrame) -> DataFrame:
    """Ranking of queued and observed baskets by price, depth, upside and coverage."""
    out = queue.join(stats, "search_query", "full").select(
        F.coalesce("tier", F.lit("Z")).alias("tier"), "search_query", F.coalesce(F.col("target_rows").cast("int"), F.lit(50)).alias("target_rows"),
        F.coalesce("cadence", F.lit("manual")).alias("cadence"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("median_price", "avg_price", "high_sale", "low_sale", "price_std", "premium_sale_pct")],
        "latest_sale_at", "latest_ingested_at",
    )
    top = stats.agg(F.coalesce(F.nullif(F.max("median_price"), F.lit(0.0)), F.lit(1.0)).alias("m")).scalar()
    covered = F.least(F.col("n_rows") / F.greatest(F.col("target_rows"), F.lit(1)) * 100, F.lit(100.0))
    out = out.withColumn("coverage_pct", covered).withColumn(
        "price_volatility", F.coalesce(F.col("price_std") / F.when(F.col("median_price") > 0, F.col("median_price")), F.lit(0.0))
    )
    score = (
        40 * money.safe_log_ratio(F.col("median_price"), top)
        + 25 * money.safe_log_ratio(F.col("n_rows"), F.col("target_rows"))
        + 20 * F.col("premium_sale_pct")
        + 15 * F.least(F.greatest(F.col("price_volatility"), F.lit(0.0)), F.lit(2.0)) / 2
        - 10 * F.col("coverage_pct") / 100
    )
    action = F.when(F.col("n_rows") >= F.col("target_rows"), "monitor").otherwise("ingest_more")
    return out.withColumn("radar_score", F.round(score, 2)).withColumn("next_action", action).drop("price_std").orderBy(
        F.col("radar_score").desc(), F.col("n_rows").desc(), "search_query"
    )


# --- letter and console --------------------------------------------------------------------
def grading_leaderboard(ev: DataFrame, card: DataFrame, player: DataFrame, n: int = 50) -> DataFrame:
    return (
        at_latest(ev)
        .join(card.select("card_id", "card_year", "set_name", "parallel", "player_id"), "card_id")
        .join(player.select("player_id", F.col("name").alias("player")), "player_id", "left")
        .drop("player_id")
        .orderBy(F.col("ev_per_dollar").desc_nulls_last(), "card_id")
        .limit(n)
    )


def index_returns(series: DataFrame, month: str, by: Sequence[str] = ()) -> DataFrame:
    """1, 3 and 12 month return of each index series at a month's end; 0 without a base."""
    end = F.last_day(F.lit(f"{month}-01").cast("date")).cast("timestamp")
    cuts = {"r1m": 1, "r3m": 3, "r12m": 12}
    at = F.col("as_of")

    def value(cut: Column) -> Column:
        return F.max_by("index_value", F.when(at <= cut, at))

    return series.groupBy(*by).agg(
        *[F.coalesce(value(end) / value(F.add_months(end.cast("date"), -k).cast("timestamp")) - 1, F.lit(0.0)).alias(n) for n, k in cuts.items()]
    )


def month_trades(trades: DataFrame, month: str) -> DataFrame:
    first = F.lit(f"{month}-01").cast("date")
    return trades.where((F.col("trade_date") >= first) & (F.col("trade_date") < F.add_months(first, 1))).orderBy("trade_date", "card_id")


def fee_drag(tx: DataFrame, year: int) -> DataFrame:
    """Fees over gross for one calendar year; the range filter reaches the scan."""
    lo, hi = (F.lit(f"{y}-01-01").cast("timestamp") for y in (year, year + 1))
    inside = tx.where((F.col("sold_at") >= lo) & (F.col("sold_at") < hi))
    gross = F.coalesce(F.sum("price_usd"), F.lit(0.0))
    return inside.agg(F.coalesce(F.coalesce(F.sum("fee_estimate"), F.lit(0.0)) / F.when(gross > 0, gross), F.lit(0.0)).alias("fee_drag"))


def sleeve_allocation(positions: DataFrame, current: DataFrame) -> DataFrame:
    """Target and current weight per sleeve of the newest allocation."""
    joined = at_latest(positions).join(current, "card_id", "left")
    return joined.groupBy("sleeve").agg(
        F.sum("target_weight_pct").alias("target_weight"), F.coalesce(F.sum("current_weight"), F.lit(0.0)).alias("current_weight")
    )


def latest_run_nav(runs: DataFrame) -> DataFrame:
    newest = runs.agg(F.max("run_id").alias("r")).scalar()
    return runs.where(F.col("run_id") == newest).select("date", "nav").orderBy("date")


def targets_for(targets: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    return targets.where(F.col("as_of_date") == as_of).join(ids.select("card_id").distinct(), "card_id", "left_semi")


def open_signals(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("resolved_at").isNull()).orderBy(F.col("as_of_date").desc(), F.col("signal_id").desc())


def failures_with_titles(failures: DataFrame, raw: DataFrame, limit: int = 200) -> DataFrame:
    page = failures.orderBy(F.col("raw_id").desc()).limit(limit)
    return page.join(raw.select("raw_id", "source", "raw_title"), "raw_id", "left")


def card_browse(card: DataFrame, manufacturer: str | None = None, set_name: str | None = None, year: int | None = None) -> DataFrame:
    for column, value in (("manufacturer", manufacturer), ("set_name", set_name), ("card_year", year)):
        if value is not None:
            card = card.where(F.col(column) == value)
    return card


def status_filter(holdings: DataFrame, status: str = "held") -> DataFrame:
    return holdings if status == "all" else holdings.where(F.col("status") == status)
