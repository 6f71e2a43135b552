"""Sleeve allocation, tilts, overrides, risk measures and NAV analytics.

Positions carry an ``as_of_date``, so one job can allocate many rebalance dates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slabmill.config import ANCHORS, Allocation
from slabmill.functions import cards
from slabmill.operators.asof import asof_slice, asof_slice_closed, first_by, latest_by
from slabmill.operators.ordering import spread_row_number, value_bucket
from slabmill.session import stage

DATE = "as_of_date"


# --- universe inputs ---------------------------------------------------------
def anchor_specs(spark: SparkSession) -> DataFrame:
    schema = "card_year int, manufacturer string, set_name string, parallel string, name string, grader string, grade double"
    return spark.createDataFrame(list(ANCHORS), schema)


def resolve_anchors(specs: DataFrame, card: DataFrame, player: DataFrame) -> DataFrame:
    """Each wanted card with its id, or NULL where the catalogue lacks it.

    No broadcast is forced: the sizes seen at run time decide the join.
    """
    keys = ["card_year", "manufacturer", "set_name", "parallel", "name"]
    known = card.join(player.select("player_id", "name"), "player_id").select("card_id", *keys)
    hits = known.join(specs.select(*keys).distinct(), keys).groupBy(*keys).agg(F.min("card_id").alias("card_id"))
    return specs.join(hits, keys, "left").withColumn("resolved", F.col("card_id").isNotNull())


def anchors(specs: DataFrame, card: DataFrame, player: DataFrame, tx: DataFrame, as_of: Column) -> DataFrame:
    """Resolved anchors with their average price before ``as_of`` (NULL if never sold)."""
    found = resolve_anchors(specs, card, player).where("resolved").select("card_id").distinct()
    priced = asof_slice(tx, "sold_at", as_of).join(found, "card_id", "left_semi")
    return found.join(priced.groupBy("card_id").agg(F.avg("price_usd").alias("avg_price")), "card_id", "left")


def rookie_window(scores: DataFrame, year: int, span: int = 5) -> DataFrame:
    return scores.where(F.col("draft_year") >= year - span)


def flagship_rookie(scores: DataFrame, card: DataFrame, as_of: Column, year: int) -> DataFrame:
    """Latest score per recent player, on that player's best-ranked rookie card."""
    latest = latest_by(asof_slice_closed(scores, "fit_at", as_of), ["player_id"], ["fit_at", "premium"])
    recent = rookie_window(latest, year)
    rookies = card.where("is_rookie").withColumn("priority", cards.rookie_card_priority(F.col("set_name"), F.col("parallel")))
    best = first_by(
        rookies.where(F.col("priority").isNotNull()).select("player_id", "card_id", "priority"), ["player_id"], ["priority", "card_id"]
    )
    return best.join(recent, "player_id").select(
        "player_id", "card_id", F.col("premium").alias("stardom_score"), "draft_year", F.col("fit_at").alias("computed_at")
    )


def stardom_for_cards(card: DataFrame, scores: DataFrame, as_of: Column) -> DataFrame:
    """Latest premium known at ``as_of`` for each card's player."""
    latest = latest_by(asof_slice_closed(scores, "fit_at", as_of), ["player_id"], ["fit_at", "premium"])
    return card.select("card_id", "player_id").join(latest.select("player_id", F.col("premium").alias("stardom_premium")), "player_id").select(
        "card_id", "stardom_premium"
    )


def player_value_for_cards(card: DataFrame, per_player: DataFrame, value: str) -> DataFrame:
    """A per-player value on every card, 0 where the player has none."""
    joined = card.select("card_id", "player_id").join(per_player.select("player_id", value), "player_id", "left")
    return joined.select("card_id", F.coalesce(value, F.lit(0.0)).alias(value))


# --- allocation ------------------------------------------------------------------
def tradable(factor: DataFrame, drop_hyped: bool) -> DataFrame:
    out = factor.where(F.coalesce(F.col("liquidity_tier"), F.lit("")) != "D")
    return out.where(~F.coalesce(F.col("is_hyped"), F.lit(False))) if drop_hyped else out


def select_decile(factor: DataFrame, decile: int, long_side: bool = True) -> DataFrame:
    """Best (or worst) 1/decile of residuals per date, sport and scarcity tier; at least one each."""
    pool = tradable(factor, drop_hyped=long_side).where(F.col("mispricing_residual").isNotNull())
    ranked = spread_row_number(
        pool, "_place", "mispricing_residual", "card_id", [DATE, "sport", "parallel_tier"], descending=long_side, count_as="_size"
    )
    return ranked.where(F.col("_place") <= F.greatest(F.lit(1), F.floor(F.col("_size") / decile))).drop("_place", "_size")


def equal_weights(names: DataFrame, sleeve: str, weight: float, cap: float, source: str) -> DataFrame:
    """Equal split under a cap: ``min(sleeve / n, cap)``."""
    sizes = names.groupBy(DATE).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(weight) / F.col("_n"), F.lit(cap))
    return names.join(sizes, DATE).select(
        DATE, "card_id", F.lit(sleeve).alias("sleeve"), share.alias("target_weight_pct"), F.lit(source).alias("signal_source")
    )


def capped_proportional(names: DataFrame, sleeve: str, weight: float, cap: float, source: str) -> DataFrame:
    """Weights ``min(rate x score, cap)`` that use up the sleeve.

    At most ``sleeve / cap`` names can sit at the cap, so the rate follows from the
    few top scores of each date and two totals; no pass over a sorted sleeve.
    """
    scored = names.select(DATE, "card_id", F.greatest(F.coalesce("cs_momentum_pct", F.lit(0.5)), F.lit(1e-9)).alias("_s"))
    totals = scored.groupBy(DATE).agg(F.sum("_s").alias("_all"))
    most = math.ceil(weight / cap - 1e-9) + 1
    ranked = spread_row_number(scored, "_i", "_s", "card_id", [DATE], descending=True)
    top = ranked.where(F.col("_i") <= most)
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(DATE).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rate = (F.lit(weight) - (F.col("_i") - 1) * cap) / (F.col("_all") - F.col("_before"))
    rates = (
        top.withColumn("_before", before)
        .join(totals, DATE)
        .withColumn("_rate", rate)
        .groupBy(DATE)
        .agg(F.min_by("_rate", F.when(F.col("_s") * F.col("_rate") <= cap + 1e-15, F.col("_i"))).alias("_rate"))
    )
    share = F.when(F.col("_rate").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("_rate") * F.col("_s")))
    return scored.join(rates, DATE).select(
        DATE, "card_id", F.lit(sleeve).alias("sleeve"), share.alias("target_weight_pct"), F.lit(source).alias("signal_source")
    ).where(F.col("target_weight_pct") > 1e-12)


def top_prospects(prospects: DataFrame, n: int) -> DataFrame:
    ranked = spread_row_number(prospects, "_i", "stardom_score", "card_id", [DATE], descending=True)
    return ranked.where(F.col("_i") <= n).drop("_i")


def build_portfolio(
    anchor: DataFrame,
    factor: DataFrame | None = None,
    prospects: DataFrame | None = None,
    config: Allocation = Allocation(),
    catalyst: DataFrame | None = None,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Target positions per date. A missing sleeve's weight goes to the anchors."""
    missing = (config.factor_weight if factor is None else 0.0) + (config.prospect_weight if prospects is None else 0.0)
    parts = [equal_weights(anchor, "anchor", config.anchor_weight + missing, config.anchor_cap, "anchor")]
    if factor is not None:
        halves = 2 if config.decile_short else 1
        chosen = select_decile(factor, config.decile_long)
        parts.append(capped_proportional(chosen, "factor_long", config.factor_weight / halves, config.other_cap, "factor"))
        if config.decile_short:
            worst = select_decile(factor, config.decile_short, long_side=False)
            short = equal_weights(worst, "factor_short", config.factor_weight / 2, config.other_cap, "factor")
            parts.append(short.withColumn("target_weight_pct", -F.col("target_weight_pct")))
    if prospects is not None:
        best = top_prospects(prospects, config.prospect_top_n)
        parts.append(equal_weights(best, "prospect", config.prospect_weight, config.prospect_cap, "prospect"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if catalyst is not None:
        out = tactical_tilt(out, catalyst, config)
    out = out.withColumn("target_usd_value", F.col("target_weight_pct") * config.aum)
    if config.overlay_weight > 0 and candidates is not None:
        out = out.unionByName(grading_overlay(candidates, config))
    return out.withColumn("is_override", F.lit(False))


def grading_overlay(candidates: DataFrame, config: Allocation) -> DataFrame:
    """Per date, buy ranked candidates that still fit that date's budget, skipping those that do not.

    A round takes, for all dates at once, the longest run of the ranking that the money left can pay for; the candidate after it and all
    that cost more than what is then left drop out, and the next round goes on behind it. Running sums are taken over value buckets first
    and over rows only in the bucket where the money ends, so no ranking is in one task and no row comes to the driver.
    """
    budget = min(config.overlay_weight, config.overlay_max) * config.aum
    ranked = candidates.select(DATE, "card_id", F.col("raw_price").cast("double").alias("cost"), F.col("ev_per_dollar").cast("double").alias("_ev"))
    ranked = ranked.where("cost is not null and _ev is not null").withColumn("_bucket", -value_bucket(F.col("_ev")))
    left = ranked.withColumn("_money", F.lit(float(budget))).where(F.col("cost") <= F.col("_money"))
    bought = None
    while True:
        left = stage(left, "overlay-left")
        if bought is not None and left.isEmpty():
            break
        order = Window.partitionBy(DATE).orderBy("_bucket")
        buckets = left.groupBy(DATE, "_bucket").agg(F.sum("cost").alias("_sum"), F.first("_money").alias("_money"))
        buckets = buckets.withColumn("_upto", F.sum("_sum").over(order)).withColumn("_last", F.min(F.when(F.col("_upto") > F.col("_money"), F.col("_bucket"))).over(Window.partitionBy(DATE)))
        placed = left.join(buckets.select(DATE, "_bucket", (F.col("_upto") - F.col("_sum")).alias("_before"), "_last"), [DATE, "_bucket"])
        here = F.col("_bucket") == F.col("_last")
        rows = Window.partitionBy(DATE, "_bucket", F.when(~here, F.pmod(F.xxhash64("card_id"), F.lit(64))).otherwise(-1)).orderBy(F.desc("_ev"), "card_id")
        spent = F.col("_before") + F.when(here, F.sum("cost").over(rows.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0.0)
        fits = F.col("_last").isNull() | (F.col("_bucket") < F.col("_last")) | (here & (spent <= F.col("_money")))
        marked = stage(placed.withColumn("_fits", fits), "overlay-round")
        now = marked.where("_fits").select(DATE, "card_id", "cost")
        bought = now if bought is None else bought.union(now)
        rest = marked.where("not _fits").groupBy(DATE).agg(F.max_by("_ev", _rank()).alias("_at_ev"), F.max_by("card_id", _rank()).alias("_at_card"))
        paid = marked.where("_fits").groupBy(DATE).agg(F.sum("cost").alias("_paid"))
        behind = (F.col("_ev") < F.col("_at_ev")) | ((F.col("_ev") == F.col("_at_ev")) & (F.col("card_id") > F.col("_at_card")))
        left = (
            marked.where("not _fits").join(rest, DATE).join(paid, DATE, "left").where(behind)
            .withColumn("_money", F.col("_money") - F.coalesce("_paid", F.lit(0.0))).where(F.col("cost") <= F.col("_money"))
            .select(DATE, "card_id", "cost", "_ev", "_bucket", "_money")
        )
    return bought.select(
        DATE,
        "card_id",
        F.lit("grading_arbitrage").alias("sleeve"),
        (F.col("cost") / config.aum).alias("target_weight_pct"),
        F.lit("grading_arbitrage").alias("signal_source"),
        F.col("cost").alias("target_usd_value"),
    )


def _rank() -> Column:
    """Greatest for the first of the ranking: value descending, card ascending."""
    return F.struct("_ev", -F.col("card_id"))


def sleeve_cap(sleeve: Column, config: Allocation) -> Column:
    return F.when(sleeve == "anchor", config.anchor_cap).when(sleeve == "prospect", config.prospect_cap).otherwise(config.other_cap)


def quintile_tags(positions: DataFrame, scores: DataFrame, quintile: int = 5) -> DataFrame:
    """Tag top and bottom 1/quintile of each sleeve by score; unscored cards count as 0."""
    scored = positions.join(scores.select("card_id", "catalyst_score"), "card_id", "left").withColumn(
        "catalyst_score", F.coalesce("catalyst_score", F.lit(0.0))
    )
    ranked = spread_row_number(scored, "_i", "catalyst_score", "card_id", [DATE, "sleeve"], descending=True, count_as="_n")
    k = F.floor(F.col("_n") / quintile)
    tag = F.when(F.col("_i") <= k, "top").when(F.col("_i") > F.col("_n") - k, "bottom").otherwise("middle")
    return ranked.withColumn("tag", tag).drop("_i", "_n")


def tactical_tilt(positions: DataFrame, scores: DataFrame, config: Allocation = Allocation()) -> DataFrame:
    """Shift weight toward high event scores inside each sleeve, keeping its total."""
    tagged = quintile_tags(positions, scores, config.tilt_quintile).withColumn("_w", F.abs("target_weight_pct"))

    def total(tag: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("_w"))), F.lit(0.0))

    sums = tagged.groupBy(DATE, "sleeve").agg(
        (config.tilt_pct * (total("top") - total("bottom"))).alias("_net"),
        total("middle").alias("_mid"),
        F.count(F.when(F.col("tag") == "top", 1)).alias("_nt"),
        F.count(F.when(F.col("tag") == "bottom", 1)).alias("_nb"),
    )
    w, net, mid, tag = F.col("_w"), F.col("_net"), F.col("_mid"), F.col("tag")
    moves, use_mid = F.abs(net) > 1e-12, F.col("_mid") > 1e-12
    top = w * (1 + config.tilt_pct) - F.when(moves & ~use_mid & (net > 0), net / F.col("_nt")).otherwise(0.0)
    bottom = w * (1 - config.tilt_pct) + F.when(moves & ~use_mid & (net < 0), -net / F.col("_nb")).otherwise(0.0)
    middle = w * F.when(moves & use_mid, F.greatest(F.lit(0.0), (mid - net) / mid)).otherwise(1.0)
    shifted = F.when(tag == "top", F.greatest(top, F.lit(0.0))).when(tag == "bottom", bottom).otherwise(middle)
    capped = F.least(shifted, sleeve_cap(F.col("sleeve"), config))
    sign = F.when(F.col("sleeve") == "factor_short", -1.0).otherwise(1.0)
    return (
        tagged.join(sums, [DATE, "sleeve"])
        .withColumn("_new", capped)
        .where(F.col("_new") > 1e-12)
        .select(DATE, "card_id", "sleeve", (sign * F.col("_new")).alias("target_weight_pct"), "signal_source")
    )


def apply_overrides(positions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace weights by stored overrides and rescale the dollars."""
    joined = positions.join(overrides.select("card_id", F.col("target_weight_pct").alias("_o")), "card_id", "left")
    w, o = F.col("target_weight_pct"), F.col("_o")
    dollars = F.when(w != 0, o * F.col("target_usd_value") / w).otherwise(0.0)
    return joined.select(
        *[c for c in positions.columns if c not in ("target_weight_pct", "target_usd_value", "is_override")],
        F.coalesce(o, w).alias("target_weight_pct"),
        F.when(o.isNotNull(), dollars).otherwise(F.col("target_usd_value")).alias("target_usd_value"),
        (F.col("is_override") | o.isNotNull()).alias("is_override"),
    )


def cap_violations(positions: DataFrame, config: Allocation = Allocation()) -> DataFrame:
    cap = sleeve_cap(F.col("sleeve"), config)
    return positions.where(F.abs("target_weight_pct") > cap + 1e-9).select(
        "card_id", "sleeve", F.col("target_weight_pct").alias("weight_pct"), cap.alias("cap_pct")
    )


# --- risk ------------------------------------------------------------------------
def concentration(positions: DataFrame, meta: DataFrame, group: Column) -> DataFrame:
    """Squared share of absolute weight per group label."""
    w = positions.join(meta, "card_id", "left").select(
        F.coalesce(group.cast("string"), F.lit("unknown")).alias("grp"), F.abs("target_weight_pct").alias("w")
    )
    total = positions.agg(F.sum(F.abs("target_weight_pct")).alias("t")).scalar()
    shares = w.groupBy("grp").agg(F.sum("w").alias("w"))
    return shares.select("grp", F.pow(F.col("w") / total, 2.0).alias("share_squared")).where(F.col("share_squared").isNotNull())


def herfindahl(positions: DataFrame) -> DataFrame:
    """Concentration over single positions and total long weight, from plain sums."""
    w = F.abs("target_weight_pct")
    return positions.agg(
        F.coalesce(F.sum(w * w) / F.nullif(F.pow(F.sum(w), 2.0), F.lit(0.0)), F.lit(0.0)).alias("hhi"),
        F.coalesce(F.sum(F.when(F.col("target_weight_pct") > 0, F.col("target_weight_pct"))), F.lit(0.0)).alias("long_weight"),
    )


def beta(returns: DataFrame, own: str = "r", index: str = "i") -> DataFrame:
    """OLS slope over rows with both returns; 0 when it is undefined."""
    both = returns.dropna(subset=[own, index])
    slope = F.covar_pop(own, index) / F.nullif(F.var_pop(index), F.lit(0.0))
    return both.agg(F.when(F.count(F.lit(1)) >= 2, F.coalesce(slope, F.lit(0.0))).otherwise(0.0).alias("beta"))


def cost_basis_weights(holdings: DataFrame) -> DataFrame:
    held = holdings.where("status = 'held'")
    total = held.agg(F.sum("acquired_cost_usd").alias("t")).scalar()
    by_card = held.groupBy("card_id").agg(F.sum("acquired_cost_usd").alias("cost"))
    return by_card.select("card_id", (F.col("cost") / total).alias("current_weight")).where(F.col("current_weight").isNotNull())


def trade_list(positions: DataFrame, holdings: DataFrame) -> DataFrame:
    """Target weight minus current weight per card."""
    want = positions.groupBy("card_id").agg(F.sum("target_weight_pct").alias("target_weight"))
    both = want.join(cost_basis_weights(holdings), "card_id", "full")
    t, c = F.coalesce("target_weight", F.lit(0.0)), F.coalesce("current_weight", F.lit(0.0))
    return both.select("card_id", t.alias("target_weight"), c.alias("current_weight"), (t - c).alias("trade_weight"))


# --- price panels and NAV ------------------------------------------------------------
def price_panel(tx: DataFrame, names: DataFrame, start: Column, end: Column) -> DataFrame:
    """Daily mean price and sales count per card in [start, end)."""
    inside = tx.where((F.col("sold_at") >= start) & (F.col("sold_at") < end))
    return inside.join(names.select("card_id").distinct(), "card_id", "left_semi").groupBy(
        F.to_date("sold_at").alias("date"), "card_id"
    ).agg(F.avg("price_usd").alias("mean_price"), F.count(F.lit(1)).alias("volume"))


def price_intervals(panel: DataFrame) -> DataFrame:
    """For how long each daily price holds: ``card_id``, ``date`` (first day), ``until`` (first day after it, NULL for the last known price), ``price``.

    A panel has one row per card and day, so a window over a card sees no more than the calendar. NULL prices end no interval.
    """
    known = panel.where(F.col("mean_price").isNotNull())
    until = F.lead("date").over(Window.partitionBy("card_id").orderBy("date"))
    return known.select("card_id", "date", until.alias("until"), F.col("mean_price").alias("price"))


def locf_panel(panel: DataFrame) -> DataFrame:
    """Last known price for every calendar day from a card's first price to the panel's end: each interval's days, without a join."""
    last_day = panel.agg(F.max("date").alias("d")).scalar()
    final = F.coalesce(F.date_sub("until", 1), last_day)
    return price_intervals(panel).select(F.explode(F.sequence("date", final, F.expr("interval 1 day"))).alias("date"), "card_id", "price")


def prices_on(panel: DataFrame, day: Column) -> DataFrame:
    """Each card's last known price on one day, combined map-side."""
    known = panel.where((F.col("date") <= day) & F.col("mean_price").isNotNull())
    return known.groupBy("card_id").agg(F.max_by("mean_price", "date").alias("price"))


def trailing_volume(panel: DataFrame, days: int = 90) -> DataFrame:
    """Sales in the ``days`` calendar days before each panel day (that day excluded)."""
    numbered = panel.withColumn("_d", F.datediff("date", F.lit("1970-01-01")))
    window = Window.partitionBy("card_id").orderBy("_d").rangeBetween(-days, -1)
    return numbered.withColumn("trailing_volume", F.coalesce(F.sum("volume").over(window), F.lit(0))).drop("_d")


def liquidity_cap(panel: DataFrame, pct: float = 0.05) -> DataFrame:
    return trailing_volume(panel).select("date", "card_id", (F.lit(pct) * F.col("trailing_volume")).alias("max_units"))


def target_units(positions: DataFrame, prices: DataFrame, aum: float) -> DataFrame:
    usable = prices.where(F.col("price") > 0).select("card_id", "price")
    return positions.join(usable, "card_id").select(
        "card_id", "sleeve", (F.col("target_weight_pct") * aum / F.col("price")).alias("units")
    )


def value_changes(units: DataFrame, prices: DataFrame) -> DataFrame:
    """By how much the worth of all holdings changes, for each day on which it does.

    ``units``: ``card_id``, ``date``, ``units`` held from that day on (at most one row per card and day); ``prices``: ``card_id``, ``date``, ``price``
    likewise. A card's worth changes only where one of its rows begins, and counts from the day on which both are known.
    """
    sides = units.where("units is not null").select("card_id", "date", "units", F.lit(None).cast("double").alias("price")).unionByName(
        prices.where("price is not null").select("card_id", "date", F.lit(None).cast(units.schema["units"].dataType).alias("units"), F.col("price").cast("double").alias("price"))
    )
    days = sides.groupBy("card_id", "date").agg(F.max("units").alias("units"), F.max("price").alias("price"))
    order = Window.partitionBy("card_id").orderBy("date")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held, paid = F.last("units", ignorenulls=True).over(so_far), F.last("price", ignorenulls=True).over(so_far)
    worth = days.select("card_id", "date", F.coalesce(held * paid, F.lit(0.0)).cast("decimal(38,12)").alias("worth"))
    change = F.col("worth") - F.coalesce(F.lag("worth").over(order), F.lit(0).cast("decimal(38,12)"))
    return worth.select("date", change.alias("change")).where("change <> 0").groupBy("date").agg(F.sum("change").cast("decimal(38,12)").alias("change"))


def mark_to_market(units: DataFrame, prices: DataFrame, cash: DataFrame) -> DataFrame:
    """Net asset value on every day of ``cash`` (``date``, ``cash``): cash plus the running sum of all changes of units times price.

    No row per card and day is made: the only running sum over days has one row a day. Sums are exact to 12 decimals, whatever their order.
    """
    days = cash.select("date", "cash", F.lit(None).cast("decimal(38,12)").alias("change"))
    moves = value_changes(units, prices).select("date", F.lit(None).cast("double").alias("cash"), "change")
    by_day = days.unionByName(moves).groupBy("date").agg(F.max("cash").alias("cash"), F.sum("change").alias("change"))
    worth = F.sum(F.coalesce("change", F.lit(0).cast("decimal(38,12)"))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return by_day.select("date", "cash", worth.cast("double").alias("worth")).where("cash is not null").select("date", (F.col("cash") + F.col("worth")).alias("nav"))


def nav_curve(nav: DataFrame) -> DataFrame:
    """Running maximum, drawdown and period return; one row per day, so one small window."""
    order = Window.orderBy("date")
    peak = F.max("nav").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return nav.select(
        "date", "nav", peak.alias("running_max"), (F.col("nav") / peak - 1).alias("drawdown"),
        F.coalesce(F.col("nav") / F.lag("nav").over(order) - 1, F.lit(0.0)).alias("ret"),
    )


def nav_metrics(nav: DataFrame, fees: DataFrame, initial: float, trades: int | Column = 0) -> DataFrame:
    spread = F.stddev_pop("ret")
    ratio = F.when(spread > 0, F.avg("ret") * 252 / (spread * math.sqrt(252))).otherwise(0.0)
    paid = fees.agg(F.coalesce(F.sum("fees"), F.lit(0.0)).alias("f")).scalar()
    return nav_curve(nav).agg(
        F.max_by("nav", "date").alias("final_nav"),
        (F.max_by("nav", "date") / initial - 1).alias("total_return"),
        ratio.alias("ir"),
        F.min("drawdown").alias("max_drawdown"),
    ).select("*", (paid / initial).alias("fee_drag_pct"), paid.alias("total_fees_usd"),
             (trades if isinstance(trades, Column) else F.lit(trades)).cast("bigint").alias("trade_count"))


def monthly_nav(nav: DataFrame) -> DataFrame:
    return nav.groupBy(F.date_trunc("month", "date").alias("month_start")).agg(F.max_by("nav", "date").alias("nav"))


# --- rebalance dates -------------------------------------------------------------------
def known_on_dates(facts: DataFrame, ts: str, keys: Sequence[str], order: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """Latest row per key strictly before each date, all dates from one scan.

    A fact is folded into the first date that can see it; the running latest over
    dates then needs one row per key and date only.
    """
    grid = F.array(*[F.lit(d).cast("timestamp") for d in sorted(dates)])
    rest = [c for c in facts.columns if c not in keys]
    seen = facts.withColumn("_d", F.get(F.filter(grid, lambda d: d > F.col(ts)), F.lit(0))).where(F.col("_d").isNotNull())
    per_date = seen.groupBy(*keys, "_d").agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    names = per_date.select(*keys).distinct().select(*keys, F.explode(grid).alias("_d"))
    carry = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    filled = names.join(per_date, [*keys, "_d"], "left").withColumn("_row", F.last("_row", ignorenulls=True).over(carry))
    return filled.where(F.col("_row").isNotNull()).select(F.col("_d").cast("date").alias(DATE), *keys, "_row.*")
