"""Value of sending raw cards to be graded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabmill.config import GradingGate
from slabmill.functions import money
from slabmill.operators.asof import asof_slice, asof_slice_closed
from slabmill.operators.ordering import exact_quantiles

GATE = GradingGate()
COUNTED_GRADES = (10, 9, 8)


def _at_date(picked, extreme: Column, ts: Column, when: Column, grade: int) -> Column:
    """Population of one grade on the extreme date itself, 0 if that date lacks the grade."""
    mine = when & (F.col("grade") == grade)
    at = F.when(mine, ts)
    value = (F.max_by if picked == "last" else F.min_by)(F.when(mine, F.col("pop_count")), at)
    day = (F.max if picked == "last" else F.min)(at)
    return F.coalesce(F.when(day == extreme, value), F.lit(0))


def gem_rates(pop: DataFrame, as_of: Column, gate: GradingGate = GATE) -> DataFrame:
    """Latest-snapshot top-grade share per card, shrunk to a prior; one aggregation."""
    known = asof_slice_closed(pop, "snapshot_date", as_of).where(F.col("grader") == "PSA")
    date = F.col("snapshot_date")
    p10, p9, p8 = (_at_date("last", F.max(date), date, F.lit(True), g) for g in COUNTED_GRADES)
    latest = known.groupBy("card_id").agg(p10.alias("p10"), p9.alias("p9"), p8.alias("p8"))
    n = F.col("p10") + F.col("p9") + F.col("p8")
    alpha = gate.prior * gate.prior_strength
    shrunk = F.bround((alpha + F.col("p10")) / (gate.prior_strength + n), 4)
    return latest.select(
        "card_id",
        F.when(n > 0, shrunk).otherwise(F.lit(gate.prior)).alias("gem_rate"),
        n.cast("bigint").alias("sample_size"),
        F.when(n > 0, F.col("p10") / n).alias("raw_rate"),
        F.col("p10").cast("bigint").alias("p10_pop"),
    )


def growth_shares(pop: DataFrame, as_of: Column, windows: tuple[int, ...] = (90, 365)) -> DataFrame:
    """Top-grade share of population growth between first and last snapshot of each window."""
    known = asof_slice_closed(pop, "snapshot_date", as_of, max(windows)).where(F.col("grader") == "PSA")
    date, columns = F.col("snapshot_date"), []
    for days in windows:
        inside = date >= as_of - F.expr(f"interval {days} days")
        at = F.when(inside, date)
        ends = {}
        for picked, extreme in (("first", F.min(at)), ("last", F.max(at))):
            ends[picked] = [_at_date(picked, extreme, date, inside, g) for g in COUNTED_GRADES]
        grown = sum(ends["last"], F.lit(0)) - sum(ends["first"], F.lit(0))
        columns.append(F.when(grown > 0, (ends["last"][0] - ends["first"][0]) / grown).alias(f"share_{days}"))
    return known.groupBy("card_id").agg(*columns)


def raw_clearing_price(tx: DataFrame, as_of: Column, days: int = GATE.raw_window_days) -> DataFrame:
    raw = asof_slice_closed(tx, "sold_at", as_of, days).where(F.col("slab_grader").isNull())
    return exact_quantiles(raw, ["card_id"], "price_usd", {"raw_price": 0.5})


def graded_prices(tx: DataFrame, as_of: Column) -> DataFrame:
    """Median price of the two top grades per card (only cards that have both)."""
    known = asof_slice(tx, "sold_at", as_of).where((F.col("slab_grader") == "PSA") & F.col("slab_grade").isin(9.0, 10.0))
    med = exact_quantiles(known, ["card_id", "slab_grade"], "price_usd", {"price": 0.5})
    both = med.groupBy("card_id").agg(
        F.max(F.when(F.col("slab_grade") == 10, F.col("price"))).alias("p10_price"),
        F.max(F.when(F.col("slab_grade") == 9, F.col("price"))).alias("p9_price"),
    )
    return both.where(F.col("p10_price").isNotNull() & F.col("p9_price").isNotNull())


def grading_ev(
    prices: DataFrame,
    pop: DataFrame,
    tx: DataFrame,
    as_of: Column,
    tier: str = "value_bulk",
    trend: bool = False,
    gate: GradingGate = GATE,
) -> DataFrame:
    """Expected value of grading for every card with a price for both grades."""
    out = (
        prices.join(gem_rates(pop, as_of, gate), "card_id", "left")
        .join(raw_clearing_price(tx, as_of, gate.raw_window_days), "card_id", "left")
        .withColumn("gem_rate", F.coalesce("gem_rate", F.lit(gate.prior)))
        .withColumn("sample_size", F.coalesce("sample_size", F.lit(0)))
        .withColumn("p10_pop", F.coalesce("p10_pop", F.lit(0)))
    )
    if trend:
        out = out.join(growth_shares(pop, as_of), "card_id", "left")
        factor = F.coalesce(money.gem_trend(F.col("share_90"), F.col("share_365")), F.lit(1.0))
        out = out.withColumn("gem_rate", F.bround(F.col("gem_rate") * factor, 4))
    # Money is decimal from here on, rounded half-even to cents.
    channel = F.lit("ebay")
    cents = lambda c: F.bround(c, 2).cast("decimal(14,2)")
    p10_net = cents(money.net_proceeds(F.col("p10_price"), channel))
    p9_net = cents(money.net_proceeds(F.col("p9_price"), channel))
    fee = money.cost_to_grade(F.lit(tier))
    gem, raw = F.col("gem_rate").cast("decimal(6,4)"), F.coalesce(F.col("raw_price").cast("decimal(24,12)"), F.lit(0))
    exact = gem * p10_net + (F.lit(1).cast("decimal(6,4)") - gem) * p9_net - cents(fee) - raw
    out = out.withColumn("ev", F.bround(exact, 2).cast("double"))
    per_dollar = F.when(F.col("raw_price") > 0, F.bround(F.col("ev") / F.col("raw_price"), 4))
    return out.select(
        "card_id",
        as_of.cast("date").alias("as_of_date"),
        F.lit(tier).alias("grade_tier"),
        "gem_rate",
        "p10_price",
        "p9_price",
        fee.alias("cost_to_grade"),
        "raw_price",
        "ev",
        per_dollar.alias("ev_per_dollar"),
        "p10_pop",
        "sample_size",
    )


def ev_gate(ev: DataFrame, gate: GradingGate = GATE) -> DataFrame:
    return ev.where(
        (F.col("sample_size") >= gate.min_sample)
        & F.col("raw_price").isNotNull()
        & (F.col("ev_per_dollar") >= gate.min_ev_per_dollar)
    )


def grading_candidates(*args, gate: GradingGate = GATE, **kwargs) -> DataFrame:
    return ev_gate(grading_ev(*args, gate=gate, **kwargs), gate).orderBy(F.col("ev_per_dollar").desc(), "card_id")
