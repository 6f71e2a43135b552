"""Fees, blends and price targets as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slabmill.config import AUCTION_CHANNELS, GRADING_FEES, TIER_MARGIN, UNKNOWN_TIER_MARGIN, Fees, Pricing

DEFAULT_FEES = Fees()
DEFAULT_PRICING = Pricing()


def net_proceeds(gross: Column, channel: Column, fees: Fees = DEFAULT_FEES) -> Column:
    """What a seller keeps; NULL for an unknown channel."""
    return (
        F.when(channel == "ebay", gross * (1 - fees.marketplace_pct) - fees.marketplace_flat)
        .when(channel.isin(*AUCTION_CHANNELS), gross * (1 - fees.auction_seller_pct))
        .when(channel == "private", gross * (1 - fees.private_pct))
    )


def landed_cost(gross: Column, channel: Column, fees: Fees = DEFAULT_FEES) -> Column:
    """What a buyer pays in total; NULL for an unknown channel."""
    return F.when(channel.isin("ebay", "private"), gross).when(
        channel.isin(*AUCTION_CHANNELS), gross * (1 + fees.auction_buyer_pct)
    )


def round_trip_cost(buy: Column, sell: Column, buy_channel: Column, sell_channel: Column, fees: Fees = DEFAULT_FEES):
    friction = landed_cost(buy, buy_channel, fees) - net_proceeds(sell, sell_channel, fees)
    return F.when(buy > 0, friction / buy)


def cost_to_grade(tier: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in GRADING_FEES.items() for x in item])
    return F.try_element_at(table, tier)


def regrade_cost(declared: Column, fees: Fees = DEFAULT_FEES) -> Column:
    return F.greatest(F.lit(GRADING_FEES["regular"]), declared * fees.regrade_pct)


def tier_margin(tier: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in TIER_MARGIN.items() for x in item])
    return F.coalesce(F.try_element_at(table, tier), F.lit(UNKNOWN_TIER_MARGIN))


def recency_confidence(days: Column, pricing: Pricing = DEFAULT_PRICING) -> Column:
    return F.coalesce(F.exp(-days / F.lit(pricing.tau_days)), F.lit(0.0))


def blend(index_value: Column, model_value: Column, confidence: Column) -> Column:
    mixed = confidence * index_value + (1 - confidence) * model_value
    return F.coalesce(mixed, index_value, model_value)


def price_targets(fair: Column, half_spread: Column, tier: Column, zscore: Column, pricing: Pricing = DEFAULT_PRICING):
    """bid, sell and stop columns; the stop always sits below the bid."""
    margin = tier_margin(tier)
    bid = fair * (1 - half_spread - margin)
    sell = fair * (1 + half_spread + zscore * pricing.sell_gain)
    stop = F.least(fair * (1 - 2 * margin), bid - margin * fair)
    return bid, sell, stop


def spread_from_ranges(high: Column, low: Column, next_high: Column, next_low: Column) -> Column:
    """High-low spread estimate of two neighbouring trading days (2012 estimator)."""
    k = 3.0 - 2.0 * math.sqrt(2.0)

    def log_range(hi: Column, lo: Column) -> Column:
        return F.pow(F.log(F.when(lo > 0, hi / lo).otherwise(1.0)), 2.0)

    beta = log_range(high, low) + log_range(next_high, next_low)
    gamma = log_range(F.greatest(high, next_high), F.least(low, next_low))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    alpha = F.greatest(alpha, F.lit(0.0))
    return 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))


def grading_ev(gem: Column, p10_net: Column, p9_net: Column, fee: Column, raw: Column) -> Column:
    return gem * p10_net + (1 - gem) * p9_net - fee - F.coalesce(raw, F.lit(0.0))


def gem_trend(share_90: Column, share_365: Column) -> Column:
    falling = (share_365 - share_90) >= 0.05
    return F.when((share_365 != 0) & falling, F.bround(share_90 / share_365, 4)).otherwise(F.lit(1.0))


def safe_log_ratio(value: Column, top: Column) -> Column:
    return F.when((value > 0) & (top > 0), F.log1p(value) / F.log1p(top)).otherwise(0.0)
