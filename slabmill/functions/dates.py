"""Date and season columns."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(value: date | datetime | str) -> Column:
    """Timestamp literal from a date, datetime or ISO text, in the session zone (UTC)."""
    return F.lit(str(value)).cast("timestamp")


def end_of_day(value: date | str) -> Column:
    """A plain date means its last instant."""
    return ts(value) + F.expr("interval 1 day") - F.expr("interval 1 microsecond")


def shift(value: date | str, days: int) -> str:
    return (date.fromisoformat(str(value)[:10]) + timedelta(days=days)).isoformat()


def week_monday(c: Column) -> Column:
    return F.date_trunc("week", c)


def week_tuesday(c: Column) -> Column:
    """Weeks that run Tuesday to Monday, labelled by their Tuesday."""
    day = F.expr("interval 1 day")
    return F.date_trunc("week", c - day) + day


def month_start(c: Column) -> Column:
    return F.date_trunc("month", c)


def day_start(c: Column) -> Column:
    return F.date_trunc("day", c)


def seconds(c: Column) -> Column:
    """Epoch seconds with microseconds kept."""
    return F.unix_micros(c) / F.lit(1e6)


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days as a fraction."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor(days_between(later, earlier)).cast("int")


def age_years(at: Column, born: Column) -> Column:
    return F.floor(days_between(at, born.cast("timestamp"))) / F.lit(365.25)


def years_since(at: Column, year: Column) -> Column:
    return F.year(at) - year


def season_end_year(season: Column) -> Column:
    """'2017-18' and '2018' both give 2018; '1999-00' gives 2000."""
    start = F.regexp_extract(season, r"^(\d{4})", 1).try_cast("int")
    tail = F.regexp_extract(season, r"^\d{4}-(\d{2})$", 1).try_cast("int")
    same = F.floor(start / 100).cast("int") * 100 + tail
    return F.when(tail.isNull(), start).otherwise(F.when(same < start, same + 100).otherwise(same))


def season_end_date(season: Column) -> Column:
    """Awards are dated June 30 of the year after the season's start year."""
    start = F.regexp_extract(season, r"^(\d{4})", 1).try_cast("int")
    year = F.when(season.contains("-"), start + 1).otherwise(start)
    return F.make_date(year, F.lit(6), F.lit(30)).cast("timestamp")


def season_label(start_year: Column) -> Column:
    return F.concat_ws("-", start_year.cast("string"), F.lpad(((start_year + 1) % 100).cast("string"), 2, "0"))


def current_season(day: Column) -> Column:
    """A season starts in October."""
    return season_label(F.when(F.month(day) >= 10, F.year(day)).otherwise(F.year(day) - 1))


def short_date(text: Column, year_hint: Column) -> Column:
    """'Jan 15', 'January 15' or '2025-01-15'; the hint supplies a missing year."""
    month = F.substring(F.regexp_extract(text, r"^\s*([A-Za-z]{3,9})\s+\d{1,2}\s*$", 1), 1, 3)
    day = F.regexp_extract(text, r"^\s*[A-Za-z]{3,9}\s+(\d{1,2})\s*$", 1)
    spelled = F.try_to_timestamp(F.concat_ws(" ", F.initcap(month), day, year_hint.cast("string")), F.lit("MMM d yyyy"))
    iso = F.try_to_timestamp(F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})\s*$", 1), F.lit("yyyy-MM-dd"))
    return F.coalesce(spelled, iso).cast("date")
