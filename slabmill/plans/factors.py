"""Momentum, liquidity and the combined factor panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabmill.functions import cards, dates
from slabmill.operators.asof import asof_slice
from slabmill.operators.ordering import exact_quantiles, tie_percent_rank

MOMENTUM_WINDOWS = (30, 90, 365)


def _days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"interval {int(days)} days")


def weekly_medians(tx: DataFrame) -> DataFrame:
    """Median price and sales per card and Tuesday week."""
    dated = tx.withColumn("week_start", dates.week_tuesday(F.col("sold_at")))
    return exact_quantiles(dated, ["card_id", "week_start"], "price_usd", {"median_price": 0.5}, count_as="n_sales")


def _price_stats(tx: DataFrame, as_of: Column) -> DataFrame:
    """Weekly medians (kind 0), last-week median (1), prior-weeks median (2), one pass."""
    sold = F.col("sold_at")
    recent, prior = _days_before(as_of, 7), _days_before(as_of, 30)
    groups = F.array(
        F.struct(F.lit(0).alias("kind"), dates.week_tuesday(sold).alias("week_start")),
        F.when(sold >= recent, F.struct(F.lit(1).alias("kind"), F.lit(0).cast("timestamp").alias("week_start"))),
        F.when(
            (sold < recent) & (sold >= prior),
            F.struct(F.lit(2).alias("kind"), F.lit(0).cast("timestamp").alias("week_start")),
        ),
    )
    tagged = tx.select("card_id", "price_usd", F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("g"))
    tagged = tagged.select("card_id", "price_usd", "g.kind", "g.week_start")
    return exact_quantiles(
        tagged, ["card_id", "kind", "week_start"], "price_usd", {"median_price": 0.5}, count_as="n_sales"
    )


def _simple_return(since: Column) -> Column:
    inside = F.when((F.col("kind") == 0) & (F.col("week_start") >= since), F.col("week_start"))
    first, last = F.min_by("median_price", inside), F.max_by("median_price", inside)
    enough = (F.count(inside) >= 2) & (first > 0)
    return F.when(enough, last / first - 1)


def _weighted_end(rows: Column) -> Column:
    """Volume-weighted mean of a few (week, median, n) structs."""
    total = F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["median_price"] * r["n_sales"])
    weight = F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["n_sales"])
    return total / weight


def _weighted_return(since: Column) -> Column:
    """Return between volume-weighted ends; a card has at most ~60 weekly rows here."""
    row = F.struct("week_start", "median_price", "n_sales")
    rows = F.sort_array(F.collect_list(F.when((F.col("kind") == 0) & (F.col("week_start") >= since), row)))
    n = F.size(rows)
    k = F.least(F.lit(2), F.greatest(F.lit(1), F.floor(n / 2))).cast("int")
    start = _weighted_end(F.slice(rows, F.lit(1), k))
    end = _weighted_end(F.slice(rows, F.greatest(n - k + 1, F.lit(1)), k))
    return F.when(n >= 2, F.when(start > 0, end / start - 1))


def momentum_panel(
    tx: DataFrame,
    as_of: Column,
    lookback: int = 90,
    min_sales: int = 3,
    volume_weight: bool = False,
) -> DataFrame:
    """Trailing returns, cross-sectional rank and hype flag per card."""
    history = asof_slice(tx, "sold_at", as_of, max(400, lookback + 30)).where(F.col("price_usd").isNotNull())
    history = history.select("card_id", "sold_at", "price_usd")
    counts = (
        history.where(F.col("sold_at") >= _days_before(as_of, lookback))
        .groupBy("card_id")
        .agg(F.count(F.lit(1)).alias("sales_count_lookback"))
    )
    make = _weighted_return if volume_weight else _simple_return
    stats = _price_stats(history, as_of)
    returns = stats.groupBy("card_id").agg(
        *[make(_days_before(as_of, d)).alias(f"r{d}") for d in MOMENTUM_WINDOWS],
        F.max(F.when(F.col("kind") == 1, F.col("median_price"))).alias("p_recent"),
        F.max(F.when(F.col("kind") == 2, F.col("median_price"))).alias("p_prior"),
    )
    joined = counts.join(returns, "card_id", "left")
    qualified = joined.withColumn("_ranked", F.when(F.col("sales_count_lookback") >= min_sales, F.col("r90")))
    ranked = tie_percent_rank(qualified, "_ranked", "cs_momentum_pct")
    jump = F.col("p_recent") / F.col("p_prior") - 1
    return ranked.select(
        "card_id",
        "r30",
        "r90",
        "r365",
        "cs_momentum_pct",
        F.coalesce(jump > 1.0, F.lit(False)).alias("is_hyped"),
        "sales_count_lookback",
    )


def sales_activity(tx: DataFrame, as_of: Column, window: int = 90) -> DataFrame:
    """Count, dollar volume and last sale per card in one map-side-combined pass."""
    inside = F.col("sold_at") >= _days_before(as_of, window)
    return (
        asof_slice(tx, "sold_at", as_of)
        .groupBy("card_id")
        .agg(
            F.count(F.when(inside, F.lit(1))).alias("sales_count_90d"),
            F.sum(F.when(inside, F.col("price_usd"))).alias("dollar_volume_90d"),
            F.max("sold_at").alias("last_sold_at"),
        )
    )


def spread_proxy(tx: DataFrame, as_of: Column, window: int = 90, min_rows: int = 3) -> DataFrame:
    """(p90 - p10) / median over one grader's sales per card."""
    graded = asof_slice(tx, "sold_at", as_of, window).where(F.col("slab_grader") == "PSA")
    q = exact_quantiles(graded, ["card_id"], "price_usd", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, count_as="n")
    usable = (F.col("n") >= min_rows) & (F.col("p50") > 0)
    return q.select("card_id", F.when(usable, (F.col("p90") - F.col("p10")) / F.col("p50")).alias("bid_ask_proxy"))


def liquidity_panel(tx: DataFrame, universe: DataFrame, as_of: Column, window: int = 90) -> DataFrame:
    """Activity metrics for every card of the universe, sold or not."""
    out = (
        universe.select("card_id")
        .join(sales_activity(tx, as_of, window), "card_id", "left")
        .join(spread_proxy(tx, as_of, window), "card_id", "left")
    )
    sales = F.coalesce(F.col("sales_count_90d"), F.lit(0))
    recency = dates.whole_days(as_of, F.col("last_sold_at"))
    return out.select(
        "card_id",
        sales.alias("sales_count_90d"),
        F.coalesce(F.col("dollar_volume_90d"), F.lit(0.0)).alias("dollar_volume_90d"),
        "bid_ask_proxy",
        F.when(F.col("last_sold_at").isNotNull(), F.greatest(recency, F.lit(0))).alias("last_sale_recency_days"),
        cards.liquidity_tier(sales).alias("liquidity_tier"),
    )


def factor_panel(tx: DataFrame, universe: DataFrame, as_of: Column, lookback: int = 90) -> DataFrame:
    """Liquidity and momentum side by side, one row per card and as-of date."""
    liquidity = liquidity_panel(tx, universe, as_of, lookback)
    momentum = momentum_panel(tx, as_of, lookback)
    return (
        liquidity.join(momentum, "card_id", "left")
        .withColumn("is_hyped", F.coalesce(F.col("is_hyped"), F.lit(False)))
        .withColumn("as_of_date", as_of.cast("date"))
    )


PANEL_SCALES = {
    "r30": (12, 6),
    "r90": (12, 6),
    "r365": (12, 6),
    "cs_momentum_pct": (6, 4),
    "dollar_volume_90d": (18, 2),
    "bid_ask_proxy": (12, 5),
}
