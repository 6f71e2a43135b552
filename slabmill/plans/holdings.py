"""Changes to holdings and overrides as whole-table transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabmill.functions.cards import entry_decile
from slabmill.operators.asof import latest_by


def add_holdings(fresh: DataFrame, panel: DataFrame) -> DataFrame:
    """New holdings stamped with their card's latest factor decile and tier (NULL without a panel row)."""
    last = latest_by(panel.select("card_id", "as_of_date", "cs_momentum_pct", "liquidity_tier"), ["card_id"], ["as_of_date"])
    entry = last.select(
        "card_id",
        F.when(F.col("cs_momentum_pct").isNotNull(), entry_decile(F.col("cs_momentum_pct"))).alias("entry_factor_decile"),
        F.col("liquidity_tier").alias("entry_liquidity_tier"),
    )
    return fresh.join(entry, "card_id", "left").withColumn("status", F.lit("held"))


def mark_sold(holdings: DataFrame, sales: DataFrame) -> DataFrame:
    """Close the holdings listed in ``sales`` (holding_id, sold_at, sold_proceeds_usd)."""
    joined = holdings.join(sales.withColumn("_sold", F.lit(True)), "holding_id", "left")
    return joined.withColumn("status", F.when(F.col("_sold"), "sold").otherwise(F.col("status"))).drop("_sold")


def set_overrides(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace override weights by card."""
    one = latest_by(changes, ["card_id"], ["seq"]).drop("seq")
    return stored.join(one.select("card_id"), "card_id", "left_anti").unionByName(one.select(*stored.columns))


def clear_overrides(stored: DataFrame, cards: DataFrame) -> DataFrame:
    return stored.join(cards.select("card_id"), "card_id", "left_anti")
