"""Decayed event scores: at one instant, at two, and over date grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabmill import config
from slabmill.functions import dates
from slabmill.operators.asof import asof_slice_closed


def injury_weight(payload: Column, base: Column, weeks_key: str = "expected_weeks_out") -> Column:
    """Severity bands of an 'out' report from its JSON payload."""
    ending = F.get_json_object(payload, "$.season_ending") == "true"
    weeks = F.get_json_object(payload, f"$.{weeks_key}").try_cast("double")
    return (
        F.when(F.coalesce(ending, F.lit(False)), F.lit(config.SEASON_ENDING_WEIGHT))
        .when(weeks < config.LONG_INJURY_WEEKS, F.lit(config.SHORT_INJURY_WEIGHT))
        .otherwise(base)
    )


def weighted_events(events: DataFrame, payload_weight=injury_weight) -> DataFrame:
    """Add weight and half-life to each event; unknown and weightless types drop out.

    The lookups are literals inside the plan, so no join and no broadcast is needed.
    """
    weights = F.create_map(*[F.lit(x) for kv in config.EVENT_WEIGHTS.items() for x in kv])
    lives = F.create_map(*[F.lit(x) for kv in config.HALF_LIVES.items() for x in kv])
    base = F.try_element_at(weights, F.col("event_type"))
    weight = F.when(F.col("event_type") == "injury_out", payload_weight(F.col("event_payload"), base)).otherwise(base)
    life = F.coalesce(F.try_element_at(lives, F.col("event_type")), F.lit(config.HALF_LIFE_DEFAULT))
    return (
        events.withColumn("weight", weight)
        .withColumn("half_life", life)
        .where(F.col("weight").isNotNull() & (F.col("weight") != 0))
    )


def _decayed(as_of: Column, lookback: int) -> Column:
    age = dates.days_between(as_of, F.col("event_date"))
    value = F.col("weight") * F.pow(F.lit(0.5), age / F.col("half_life"))
    inside = (F.col("event_date") <= as_of) & (F.col("event_date") >= as_of - F.expr(f"interval {lookback} days"))
    return F.coalesce(F.sum(F.when(inside, value)), F.lit(0.0))


def catalyst_scores(events: DataFrame, players: DataFrame, as_of: Column, lookback: int = 90, payload_weight=injury_weight):
    """One decayed sum per player, 0 without events; never reads past ``as_of``."""
    known = weighted_events(asof_slice_closed(events, "event_date", as_of, lookback), payload_weight)
    sums = known.groupBy("player_id").agg(_decayed(as_of, lookback).alias("score"))
    return players.select("player_id").join(sums, "player_id", "left").select(
        "player_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("catalyst_score")
    )


def catalyst_change(
    events: DataFrame, players: DataFrame, as_of: Column, days: int = 30, lookback: int = 90, payload_weight=injury_weight
):
    """Score now minus score ``days`` earlier, from one scan."""
    before = as_of - F.expr(f"interval {days} days")
    known = weighted_events(asof_slice_closed(events, "event_date", as_of, lookback + days), payload_weight)
    sums = known.groupBy("player_id").agg(_decayed(as_of, lookback).alias("now"), _decayed(before, lookback).alias("prev"))
    out = players.select("player_id").join(sums, "player_id", "left")
    now, prev = (F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("now", "prev"))
    return out.select("player_id", now.alias("catalyst_score"), F.round(now - prev, 6).alias("catalyst_change"))


def daily_event_mass(events: DataFrame, payload_weight=injury_weight) -> DataFrame:
    """Events folded to (player, day, half-life): sums that decay as one event at the day's end.

    ``0.5**((T - t)/h)`` factors into ``0.5**((T - D)/h) * 0.5**((D - t)/h)``, so a
    player with billions of events shrinks to at most a few rows per calendar day
    before any join. ``D`` is the midnight at or after the event.
    """
    day = F.date_trunc("day", F.col("event_date"))
    at_midnight = F.col("event_date") == day
    end = F.when(at_midnight, day).otherwise(day + F.expr("interval 1 day"))
    known = weighted_events(events, payload_weight).withColumn("mass_day", end).withColumn("on_edge", at_midnight)
    part = F.col("weight") * F.pow(F.lit(0.5), dates.days_between(F.col("mass_day"), F.col("event_date")) / F.col("half_life"))
    return known.groupBy("player_id", "mass_day", "half_life", "on_edge").agg(F.sum(part).alias("mass"))


def catalyst_on_days(events: DataFrame, grid: DataFrame, lookback: int = 90, payload_weight=injury_weight) -> DataFrame:
    """Scores at midnights: ``grid`` has distinct (player_id, day).

    Each grid day spreads over the two ``lookback``-day blocks it can see, and the
    join runs on (player, block), so one player's history is cut into blocks.
    """
    block = float(lookback)
    mass = daily_event_mass(events, payload_weight)
    mass = mass.withColumn("block", F.floor(F.datediff("mass_day", F.lit("1970-01-01")) / block))
    day_no = F.datediff("day", F.lit("1970-01-01"))
    spread = grid.select("player_id", "day", F.explode(F.array(F.floor(day_no / block), F.floor(day_no / block) - 1)).alias("block"))
    age = F.datediff("day", "mass_day")
    inside = (age >= 0) & ((age < lookback) | ((age == lookback) & F.col("on_edge")))
    value = F.col("mass") * F.pow(F.lit(0.5), age / F.col("half_life"))
    sums = (
        spread.join(mass, ["player_id", "block"])
        .where(inside)
        .groupBy("player_id", "day")
        .agg(F.sum(value).alias("score"))
    )
    return grid.join(sums, ["player_id", "day"], "left").select(
        "player_id", "day", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("catalyst_score")
    )


def catalyst_series(
    events: DataFrame, players: DataFrame, end: str, days: int = 180, step: int = 7, payload_weight=injury_weight
) -> DataFrame:
    """Score of every player sampled each ``step`` days up to ``end``."""
    grid = players.select(
        "player_id",
        F.explode(
            F.sequence(
                F.lit(dates.shift(end, -days)).cast("timestamp"),
                F.lit(end).cast("timestamp"),
                F.expr(f"interval {step} days"),
            )
        ).alias("day"),
    )
    return catalyst_on_days(events, grid, payload_weight=payload_weight).withColumnRenamed("day", "as_of")
