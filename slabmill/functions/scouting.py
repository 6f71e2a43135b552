"""Prospect columns: leagues, positions, measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slabmill import config
from slabmill.functions.dates import season_end_year


def _table(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def league_multiplier(origin: Column) -> Column:
    table = _table((name, mle) for name, mle, _ in config.LEAGUE_EQUIVALENCY)
    return F.coalesce(F.try_element_at(table, F.upper(origin)), F.lit(0.85))


def league_strength(origin: Column) -> Column:
    table = _table((name, rank) for name, _, rank in config.LEAGUE_EQUIVALENCY)
    return F.coalesce(F.try_element_at(table, F.upper(origin)), F.lit(2))


def league_origin(league: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(config.LEAGUE_ORIGIN.items()), F.lower(league)), F.lit("OTHER_INTL"))


def origin_priority(origin: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(o) for o in config.ORIGIN_PRIORITY]), origin)
    return F.when(place > 0, place - 1).otherwise(len(config.ORIGIN_PRIORITY)).cast("int")


def years_until_draft(class_year: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(config.CLASS_YEARS_TO_DRAFT.items()), F.upper(class_year)), F.lit(0))


def expected_draft_year(season: Column, class_year: Column) -> Column:
    return season_end_year(season) + years_until_draft(class_year)


def position(raw: Column) -> Column:
    p = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    aliased = F.coalesce(F.try_element_at(_table(config.POSITION_ALIASES.items()), p), p)
    return F.substring(aliased, 1, 2)


def one_hot(value: Column, categories, prefix: str) -> list[Column]:
    return [(value == c).cast("int").alias(f"{prefix}_{c}") for c in categories]


def height_inches(text: Column) -> Column:
    """'6-7.25' as inches; plain numbers pass; anything else is NULL."""
    s = F.trim(text)
    feet = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)$", 1).try_cast("double")
    inches = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)$", 2).try_cast("double")
    plain = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)$", 1).try_cast("double")
    return F.coalesce(feet * 12 + inches, plain)


def bmi(weight: Column, height: Column) -> Column:
    return F.lit(703.0) * weight / F.nullif(height * height, F.lit(0.0))
