"""Implied spreads, fair value, trade targets, exit signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabmill.config import ExitRules, Pricing
from slabmill.functions import cards, dates, money
from slabmill.operators.asof import asof_slice, asof_slice_closed, first_by
from slabmill.operators.ordering import exact_quantiles, tie_percent_rank

DEFAULT = Pricing()


def _day_ranges(tx: DataFrame) -> DataFrame:
    return tx.groupBy("card_id", F.date_trunc("day", "sold_at").alias("day")).agg(
        F.max("price_usd").alias("high"),
        F.min("price_usd").alias("low"),
        F.count(F.lit(1)).alias("n"),
        F.max("sold_at").alias("last_at"),
    )


def trading_days(tx: DataFrame, as_of: Column, window: int = DEFAULT.spread_window_days) -> DataFrame:
    """High, low and trades per card and day, in the window ending at each card's last sale.

    Sales fold to (card, day) before any shuffle. The window's first day can start
    mid-day; only that one day per card is read a second time, joined on (card, day).
    """
    known = asof_slice_closed(tx.select("card_id", "sold_at", "price_usd"), "sold_at", as_of)
    daily = _day_ranges(known)
    cutoff = daily.groupBy("card_id").agg(
        (F.max("last_at") - F.expr(f"interval {window} days")).alias("cutoff")
    )
    whole = daily.join(cutoff, "card_id").where(F.col("day") >= F.col("cutoff"))
    partial = cutoff.withColumn("day", F.date_trunc("day", "cutoff")).where(F.col("day") < F.col("cutoff"))
    edge_sales = (
        known.withColumn("day", F.date_trunc("day", "sold_at"))
        .join(partial, ["card_id", "day"])
        .where(F.col("sold_at") >= F.col("cutoff"))
        .drop("day", "cutoff")
    )
    keep = ["card_id", "day", "high", "low", "n"]
    return whole.select(*keep).union(_day_ranges(edge_sales).select(*keep))


def day_spreads(days: DataFrame) -> DataFrame:
    """Spread estimate of each pair of neighbouring trading days (a card has <= 61 rows)."""
    order = Window.partitionBy("card_id").orderBy("day")
    nxt_high, nxt_low = F.lead("high").over(order), F.lead("low").over(order)
    paired = days.withColumn("next_high", nxt_high).withColumn("next_low", nxt_low)
    spread = money.spread_from_ranges(F.col("high"), F.col("low"), F.col("next_high"), F.col("next_low"))
    return paired.withColumn("spread", F.when(F.col("next_high").isNotNull(), spread))


def half_spread(tx: DataFrame, tiers: DataFrame, as_of: Column, pricing: Pricing = DEFAULT) -> DataFrame:
    """Median implied half-spread per card of ``tiers`` (card_id, liquidity_tier), with tier fallback."""
    est = (
        day_spreads(trading_days(tx, as_of, pricing.spread_window_days))
        .groupBy("card_id")
        .agg(F.sum("n").alias("trades"), F.median("spread").alias("spread"))
    )
    good = F.when(F.col("trades") >= pricing.spread_min_trades, F.col("spread") / 2)
    return tiers.join(est, "card_id", "left").select(
        "card_id", F.coalesce(good, money.tier_margin(F.col("liquidity_tier"))).alias("half_spread")
    )


def last_and_cap(tx: DataFrame, as_of: Column, pricing: Pricing = DEFAULT) -> DataFrame:
    """Last sale per card in the lookback, capped at an upper quantile of the same sales."""
    known = asof_slice_closed(tx, "sold_at", as_of, pricing.lookback_days)
    last = known.groupBy("card_id").agg(
        F.max("sold_at").alias("last_sold_at"),
        F.max_by("price_usd", F.struct("sold_at", "tx_id", "price_usd")).alias("last_price"),
    )
    cap = exact_quantiles(known, ["card_id"], "price_usd", {"cap": pricing.winsor_pct})
    return last.join(cap, "card_id").select("card_id", "last_sold_at", F.least("last_price", "cap").alias("last_price"))


def index_by_day(index: DataFrame, as_of: Column) -> DataFrame:
    """(era, day, value): the default series carried forward to every calendar day.

    Size is eras x days whatever the sales volume, which is what makes broadcasting it safe.
    """
    series = index.where(
        (F.col("bucket") == "weekly") & (F.col("grade_tier") == "PSA10") & (F.col("period_start") <= as_of)
    )
    points = series.where(F.col("index_value").isNotNull()).select(
        "era", F.to_date("period_start").alias("day"), "index_value"
    )
    spine = points.groupBy("era").agg(F.min("day").alias("lo"))
    spine = spine.select("era", F.explode(F.sequence("lo", as_of.cast("date"), F.expr("interval 1 day"))).alias("day"))
    carry = Window.partitionBy("era").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(points, ["era", "day"], "left").select(
        "era", "day", F.last("index_value", ignorenulls=True).over(carry).alias("index_value")
    )


def index_now(index: DataFrame, as_of: Column) -> DataFrame:
    """Per era: newest value, earliest value and newest period (one row per era)."""
    series = index.where(
        (F.col("bucket") == "weekly") & (F.col("grade_tier") == "PSA10") & (F.col("period_start") <= as_of)
    )
    known = F.when(F.col("index_value").isNotNull(), F.col("period_start"))
    return series.groupBy("era").agg(
        F.max_by("index_value", known).alias("now_value"),
        F.min_by("index_value", known).alias("first_value"),
        F.max("period_start").alias("latest"),
    )


def index_probe(last: DataFrame, card: DataFrame, index: DataFrame, as_of: Column) -> DataFrame:
    """Add the index at ``as_of`` and at each card's last sale (earliest value before the series)."""
    joined = last.join(card.select("card_id", cards.era(F.col("card_year")).alias("era")), "card_id")
    joined = joined.withColumn("day", F.to_date("last_sold_at"))
    with_now = joined.join(F.broadcast(index_now(index, as_of)), "era", "left")
    probed = with_now.join(F.broadcast(index_by_day(index, as_of)), ["era", "day"], "left")
    return probed.withColumn("then_value", F.coalesce("index_value", "first_value")).drop("index_value", "first_value", "day")


def fair_value(
    tx: DataFrame,
    card: DataFrame,
    index: DataFrame,
    as_of: Column,
    model_prices: DataFrame | None = None,
    pricing: Pricing = DEFAULT,
) -> DataFrame:
    """Index-projected last price blended with a model price by recency, for every card."""
    probed = index_probe(last_and_cap(tx, as_of, pricing), card, index, as_of)
    stale = dates.whole_days(as_of, F.col("latest")) > pricing.stale_index_days
    usable = F.col("now_value").isNotNull() & (F.col("then_value") > 0) & ~stale
    probed = probed.withColumn(
        "index_projected", F.when(usable, F.col("last_price") * F.col("now_value") / F.col("then_value"))
    )
    out = card.select("card_id").join(probed, "card_id", "left")
    if model_prices is None:
        out = out.withColumn("model_price", F.lit(None).cast("double"))
    else:
        out = out.join(model_prices.select("card_id", F.col("predicted_price").alias("model_price")), "card_id", "left")
    days = dates.whole_days(as_of, F.col("last_sold_at"))
    confidence = F.when(
        F.col("index_projected").isNotNull(), money.recency_confidence(days, pricing)
    ).otherwise(0.0)
    return out.select(
        "card_id",
        money.blend(F.col("index_projected"), F.col("model_price"), confidence).alias("fair_value"),
        confidence.alias("confidence"),
        "index_projected",
        "model_price",
        days.alias("days_since_last_sold"),
    )


def zscores(panel: DataFrame, score: str = "cs_momentum_pct") -> DataFrame:
    """Cross-sectional z-score, population deviation; 0 where it is undefined."""
    stats = panel.select(
        F.struct(F.avg(score).alias("mu"), F.stddev_pop(score).alias("sigma")).alias("s")
    ).scalar()
    z = (F.col(score) - stats["mu"]) / F.nullif(stats["sigma"], F.lit(0.0))
    return panel.select("card_id", F.coalesce(z, F.lit(0.0)).alias("zscore"))


def trade_targets(
    panel: DataFrame,
    tx: DataFrame,
    card: DataFrame,
    index: DataFrame,
    as_of: Column,
    model_prices: DataFrame | None = None,
    pricing: Pricing = DEFAULT,
) -> DataFrame:
    """Bid, sell and stop of every panel card that has a fair value."""
    tier = F.coalesce(F.col("liquidity_tier"), F.lit(pricing.missing_tier))
    base = panel.select("card_id", tier.alias("liquidity_tier"), "cs_momentum_pct")
    priced = (
        base.join(fair_value(tx, card, index, as_of, model_prices, pricing), "card_id")
        .where(F.col("fair_value").isNotNull())
        .join(half_spread(tx, base.select("card_id", "liquidity_tier"), as_of, pricing), "card_id")
        .join(zscores(base), "card_id")
    )
    bid, sell, stop = money.price_targets(
        F.col("fair_value"), F.col("half_spread"), F.col("liquidity_tier"), F.col("zscore"), pricing
    )
    return priced.select(
        "card_id",
        as_of.cast("date").alias("as_of_date"),
        "fair_value",
        bid.alias("bid_max"),
        sell.alias("sell_target"),
        stop.alias("stop_loss"),
        "confidence",
        F.col("half_spread").alias("half_spread_pct"),
        money.tier_margin(F.col("liquidity_tier")).alias("liquidity_margin_pct"),
    )


TARGET_SCALES = {
    "fair_value": (14, 2),
    "bid_max": (14, 2),
    "sell_target": (14, 2),
    "stop_loss": (14, 2),
    "confidence": (4, 3),
    "half_spread_pct": (6, 4),
    "liquidity_margin_pct": (6, 4),
}


def last_price_before(tx: DataFrame, end: Column) -> DataFrame:
    return asof_slice(tx, "sold_at", end).groupBy("card_id").agg(
        F.max_by("price_usd", F.struct("sold_at", "tx_id", "price_usd")).alias("price")
    )


def exit_probe(holdings: DataFrame, tx: DataFrame, targets: DataFrame, panel: DataFrame, as_of: Column) -> DataFrame:
    """Open holdings with last price, targets, today's tier and re-ranked momentum."""
    ranks = tie_percent_rank(panel.select("card_id", "liquidity_tier", "cs_momentum_pct"), "cs_momentum_pct", "rank_pct")
    return (
        holdings.where(F.col("status") == "held")
        .join(last_price_before(tx, as_of + F.expr("interval 1 day")), "card_id", "left")
        .join(targets.select("card_id", "sell_target", "stop_loss"), "card_id", "left")
        .join(ranks.select("card_id", F.col("liquidity_tier").alias("tier_now"), "rank_pct"), "card_id", "left")
    )


def exit_signals(
    holdings: DataFrame, tx: DataFrame, targets: DataFrame, panel: DataFrame, as_of: Column, rules: ExitRules = ExitRules()
) -> DataFrame:
    """One row per holding and fired rule; (holding, rule, date) is unique."""
    probe = exit_probe(holdings, tx, targets, panel, as_of)
    price, held = F.col("price"), dates.whole_days(as_of, F.col("acquired_at"))
    drop = cards.tier_index(F.col("tier_now")) - cards.tier_index(F.col("entry_liquidity_tier"))

    def rule(fires: Column, name: str, action: str, notes: Column) -> Column:
        return F.when(
            fires, F.struct(F.lit(name).alias("rule_triggered"), F.lit(action).alias("recommended_action"), notes.alias("notes"))
        )

    two = lambda c: F.format_string("%.2f", c)
    fired = F.array(
        rule(
            price >= F.col("sell_target"), "target_hit", "sell_50pct",
            F.concat(F.lit("last_sold="), two(price), F.lit(" >= sell_target="), two(F.col("sell_target"))),
        ),
        rule(
            (F.col("entry_factor_decile") == 10) & (F.col("rank_pct") < 1.0 - rules.top_pct), "factor_reversal", "sell_100pct",
            F.concat(F.lit("factor_rank_pct="), two(F.col("rank_pct")), F.lit(" (dropped from top decile)")),
        ),
        rule(
            (held > rules.time_stop_days) & (price < rules.time_stop_ratio * F.col("acquired_cost_usd")), "time_stop", "sell_100pct",
            F.concat(F.lit("held "), held.cast("string"), F.lit("d, price "), two(price), F.lit(f" < {rules.time_stop_ratio}×cost")),
        ),
        rule(
            price < F.col("stop_loss"), "price_stop", "sell_100pct",
            F.concat(F.lit("last_sold="), two(price), F.lit(" < stop_loss="), two(F.col("stop_loss"))),
        ),
        rule(
            drop >= rules.degrade_steps, "liquidity_degrade", "sell_100pct",
            F.concat(F.lit("tier "), F.col("entry_liquidity_tier"), F.lit(" → "), F.col("tier_now")),
        ),
    )
    return (
        probe.select("holding_id", F.explode(F.filter(fired, lambda r: r.isNotNull())).alias("r"))
        .select("holding_id", "r.rule_triggered", "r.recommended_action", as_of.cast("date").alias("as_of_date"), "r.notes")
        .dropDuplicates(["holding_id", "rule_triggered", "as_of_date"])
    )


def resolve_signals(signals: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Stamp the listed signals that are still open; ``changed`` marks rows really updated."""
    wanted = ids.select("signal_id").distinct().withColumn("_asked", F.lit(True))
    joined = signals.join(wanted, "signal_id", "left")
    changes = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("resolved_at").isNull()
    return joined.withColumn("changed", changes).withColumn(
        "resolved_at", F.when(changes, now).otherwise(F.col("resolved_at"))
    ).drop("_asked")


def dedupe_new_signals(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Signals whose natural key is not stored yet."""
    key = ["holding_id", "rule_triggered", "as_of_date"]
    return first_by(fresh, key, ["recommended_action"]).join(stored.select(*key), key, "left_anti")
