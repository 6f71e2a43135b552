"""Card attributes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slabmill.config import ERA_BOUNDARY, LIQUIDITY_FLOORS, LIQUIDITY_ORDER

# Set families and big-market teams
PREMIUM_SETS = ("national treasures", "flawless", "immaculate")
MID_SETS = ("mosaic", "optic", "donruss optic")
FLAGSHIP_SETS = ("prizm", "select", "topps chrome")
LOW_SETS = ("hoops", "donruss")
PREMIUM_TEAMS = ("LAL", "NYK", "BOS", "CHI", "TOR")


def first_match(subject: Column, table, default: Column) -> Column:
    """First (phrase, value) whose phrase occurs in the lower-cased subject."""
    out = default
    for phrase, value in reversed(list(table)):
        out = F.when(subject.contains(phrase), F.lit(value)).otherwise(out)
    return out


def parallel_tier(one_of_one: Column, print_run: Column, parallel: Column) -> Column:
    """Scarcity 0 (base) to 5 (single copy)."""
    by_name = F.when(F.lower(F.coalesce(parallel, F.lit("Base"))) == "base", 0).otherwise(1)
    by_run = F.when(print_run <= 10, 4).when(print_run <= 25, 3).when(print_run <= 99, 2).when(print_run <= 499, 1)
    return F.when(F.coalesce(one_of_one, F.lit(False)), 5).otherwise(
        F.when(print_run.isNull(), by_name).otherwise(by_run.otherwise(0))
    )


def set_tier(set_name: Column) -> Column:
    name = F.lower(F.coalesce(set_name, F.lit("")))
    table = (
        [(s, "premium") for s in PREMIUM_SETS]
        + [(s, "mid") for s in MID_SETS]
        + [(s, "flagship") for s in FLAGSHIP_SETS]
        + [(s, "low") for s in LOW_SETS]
    )
    return first_match(name, table, F.lit("flagship"))


def team_market(team: Column) -> Column:
    return F.when(F.upper(team).isin(*PREMIUM_TEAMS), "premium").otherwise("standard")


def era(year: Column) -> Column:
    return F.when(year >= ERA_BOUNDARY, "modern").otherwise("vintage")


def era_modern(year: Column) -> Column:
    return (year >= ERA_BOUNDARY).cast("int")


def decade(year: Column) -> Column:
    return F.coalesce(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")), F.lit("unknown"))


def liquidity_tier(sales: Column) -> Column:
    out = F.lit("D")
    for tier, floor in reversed(LIQUIDITY_FLOORS):
        out = F.when(sales >= floor, tier).otherwise(out)
    return out


def tier_index(tier: Column) -> Column:
    """Position in A, B, C, D; NULL for anything else."""
    place = F.array_position(F.array(*[F.lit(t) for t in LIQUIDITY_ORDER]), tier)
    return F.when(place > 0, place - 1).cast("int")


def entry_decile(pct: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(pct * 10))).cast("int")


def rookie_card_priority(set_name: Column, parallel: Column) -> Column:
    """0 = flagship silver rookie, 1 = flagship base, 2 = chrome, NULL = not eligible."""
    name = F.lower(F.coalesce(set_name, F.lit("")))
    kind = F.lower(F.coalesce(parallel, F.lit("")))
    return (
        F.when(name.contains("prizm") & kind.contains("silver"), 0)
        .when(name.contains("prizm") & kind.isin("base", ""), 1)
        .when(name.contains("topps chrome"), 2)
    )


def grade_memberships(grader: Column, grade: Column) -> Column:
    """Every grade tier a sale belongs to; 'all' overlaps the others."""
    psa = grader == "PSA"
    tiers = [
        F.when(psa & (grade == 10), "PSA10"),
        F.when(psa & (grade == 9), "PSA9"),
        F.when(psa & (grade == 8), "PSA8"),
        F.when(grader.isNotNull() & (grade < 8), "lower"),
        F.lit("all"),
    ]
    return F.filter(F.array(*tiers), lambda t: t.isNotNull())
