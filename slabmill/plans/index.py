"""Repeat-sales price index: pairs, distributed sufficient statistics, small solve."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabmill.config import ALL_TIERS, ERA_BOUNDARY, GRADE_TIERS, INDEX_TIERS
from slabmill.functions import cards, dates
from slabmill.operators.asof import next_row
from slabmill.session import stage

PARTS = ["era", "grade_tier"]


def filter_grade(tx: DataFrame, tier: str) -> DataFrame:
    if tier == "all":
        return tx
    if tier == "lower":
        return tx.where(F.col("slab_grader").isNotNull() & (F.col("slab_grade") < 8))
    if tier not in GRADE_TIERS:
        raise ValueError(f"unknown grade tier: {tier}")
    grader, grade = GRADE_TIERS[tier]
    return tx.where((F.col("slab_grader") == grader) & (F.col("slab_grade") == grade))


def filter_era(tx: DataFrame, era: str) -> DataFrame:
    """Certified sales of one era; needs a ``card_year`` column."""
    certified = tx.where(F.col("cert_number").isNotNull())
    if era == "modern":
        return certified.where(F.col("card_year") >= ERA_BOUNDARY)
    if era == "vintage":
        return certified.where(F.col("card_year") < ERA_BOUNDARY)
    return certified


def period_of(ts: Column, bucket: str) -> Column:
    if bucket == "weekly":
        return dates.week_monday(ts)
    if bucket == "monthly":
        return dates.month_start(ts)
    raise ValueError(f"unsupported bucket: {bucket}")


def partitioned_sales(tx: DataFrame, card: DataFrame, tiers: Sequence[str] = INDEX_TIERS, with_all_eras: bool = False):
    """Sales of certified cards, once per (era, grade tier) they belong to."""
    joined = tx.where(F.col("cert_number").isNotNull()).join(card.select("card_id", "card_year"), "card_id")
    eras = F.array(cards.era(F.col("card_year")), *([F.lit("all")] if with_all_eras else []))
    members = F.filter(cards.grade_memberships(F.col("slab_grader"), F.col("slab_grade")), lambda t: t.isin(*tiers))
    return joined.select(
        "tx_id", "cert_number", "sold_at", F.col("price_usd").cast("double").alias("price_usd"),
        F.explode(members).alias("grade_tier"), eras.alias("eras"),
    ).select("tx_id", "cert_number", "sold_at", "price_usd", "grade_tier", F.explode("eras").alias("era"))


def consecutive_pairs(sales: DataFrame, bucket: str = "weekly", parts: Sequence[str] = PARTS) -> DataFrame:
    """Neighbouring sales of the same item that fall in different periods."""
    parts = list(parts)
    paired = next_row(
        sales, [*parts, "cert_number"], ["sold_at", "tx_id", "price_usd"], {"t1": "sold_at", "price1": "price_usd"}
    )
    return (
        paired.where(F.col("t1").isNotNull())
        .select(
            *parts,
            "cert_number",
            F.col("sold_at").alias("t0"),
            "t1",
            period_of(F.col("sold_at"), bucket).alias("bucket0"),
            period_of(F.col("t1"), bucket).alias("bucket1"),
            F.col("price_usd").alias("price0"),
            "price1",
        )
        .where((F.col("bucket0") != F.col("bucket1")) & (F.col("price0") > 0) & (F.col("price1") > 0))
        .withColumn("log_return", F.log(F.col("price1") / F.col("price0")))
    )


def outlier_moments(pairs: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    return pairs.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("n"), F.avg("log_return").alias("mu"), F.stddev_pop("log_return").alias("sigma")
    )


def build_pairs(sales: DataFrame, bucket: str = "weekly", sigma: float | None = 3.0, parts: Sequence[str] = PARTS):
    """Pairs without outliers beyond ``sigma`` population deviations of their partition."""
    pairs = consecutive_pairs(sales, bucket, parts)
    if sigma is None:
        return pairs
    pairs = stage(pairs, "pairs")  # read for the moments and again for the filter
    # At most (eras x tiers) rows: safe to broadcast at any data size.
    moments = F.broadcast(outlier_moments(pairs, parts))
    keep = (F.col("n") <= 1) | (F.col("sigma") <= 0) | (F.abs(F.col("log_return") - F.col("mu")) <= sigma * F.col("sigma"))
    return pairs.join(moments, list(parts)).where(keep).drop("n", "mu", "sigma")


def pair_statistics(pairs: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    """Everything least squares needs: at most one row per pair of periods."""
    return pairs.groupBy(*parts, "bucket0", "bucket1").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("log_return").alias("sum_y"),
        F.sum(F.col("log_return") * F.col("log_return")).alias("sum_y2"),
    )


def endpoint_counts(pairs: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    return (
        pairs.select(*parts, F.explode(F.array("bucket0", "bucket1")).alias("period_start"))
        .groupBy(*parts, "period_start")
        .agg(F.count(F.lit(1)).alias("n_pairs"))
    )


def period_axis(pairs: DataFrame, bucket: str = "weekly", parts: Sequence[str] = PARTS) -> DataFrame:
    """Regular grid of periods from the first to the last one touched."""
    step = F.expr("interval 7 days") if bucket == "weekly" else F.expr("interval 1 month")
    ends = pairs.groupBy(*parts).agg(
        F.least(F.min("bucket0"), F.min("bucket1")).alias("lo"), F.greatest(F.max("bucket0"), F.max("bucket1")).alias("hi")
    )
    return ends.select(*parts, F.explode(F.sequence("lo", "hi", step)).alias("period_start"))


def observed_periods(pairs: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    lows, highs = (pairs.select(*parts, F.col(c).alias("period_start")) for c in ("bucket0", "bucket1"))
    return lows.union(highs).distinct()


def _solve(stats: pd.DataFrame, freq: str, base_min: int) -> pd.DataFrame:
    """Least squares on period dummies from (period pair, n, sum y, sum y^2) rows."""
    k0, k1 = stats["bucket0"], stats["bucket1"]
    axis = pd.date_range(min(k0.min(), k1.min()), max(k0.max(), k1.max()), freq=freq)
    place = pd.Series(np.arange(len(axis)), index=axis)
    i, j = place.loc[k0].to_numpy(), place.loc[k1].to_numpy()
    n, y, yy = (stats[c].to_numpy(float) for c in ("n", "sum_y", "sum_y2"))
    size = len(axis)
    gram, moment, touches = np.zeros((size, size)), np.zeros(size), np.zeros(size)
    for at, sign in ((i, -1.0), (j, 1.0)):
        np.add.at(moment, at, sign * y)
        np.add.at(touches, at, n)
        np.add.at(gram, (at, at), n)
    np.add.at(gram, (i, j), -n)
    np.add.at(gram, (j, i), -n)
    inverse = np.linalg.pinv(gram[1:, 1:], hermitian=True)
    beta = np.append(0.0, inverse @ moment[1:])
    rank = np.linalg.matrix_rank(gram[1:, 1:], hermitian=True)
    rss = max(yy.sum() - beta @ moment, 0.0)
    spread = np.sqrt(np.clip(np.diag(inverse), 0, None) * rss / max(n.sum() - rank, 1))
    solid = np.flatnonzero(touches >= base_min)
    base = beta[solid[0]] if len(solid) else beta[0]
    seen = touches > 0
    return pd.DataFrame(
        {
            "period_start": axis,
            "index_value": np.where(seen, 100.0 * np.exp(beta - base), np.nan),
            "n_pairs": touches.astype("int64"),
            "se": np.where(seen, np.append(0.0, spread), np.nan),
        }
    )


def solve_index(stats: DataFrame, bucket: str = "weekly", base_min: int = 10) -> DataFrame:
    """Solve each (era, tier): its group holds at most periods-squared rows, never sales."""
    freq = "7D" if bucket == "weekly" else "MS"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _solve(pdf, freq, base_min)
        for part in PARTS:
            out[part] = pdf[part].iloc[0]
        return out

    schema = "period_start timestamp, index_value double, n_pairs long, se double, era string, grade_tier string"
    solved = stats.groupBy(*PARTS).applyInPandas(solve, schema)
    return solved.select(
        "period_start",
        F.lit("NBA").alias("sport"),
        F.lit(bucket).alias("bucket"),
        "grade_tier",
        "era",
        F.when(~F.isnan("index_value"), F.col("index_value")).alias("index_value"),
        "n_pairs",
        F.when(~F.isnan("se"), F.col("se")).alias("se"),
    )


def repeat_sales_index(
    tx: DataFrame,
    card: DataFrame,
    bucket: str = "weekly",
    tiers: Sequence[str] = INDEX_TIERS,
    with_all_eras: bool = False,
    sigma: float | None = 3.0,
    base_min: int = 10,
) -> DataFrame:
    unknown = set(tiers) - set(ALL_TIERS)
    if unknown:
        raise ValueError(f"unknown grade tiers: {sorted(unknown)}")
    pairs = build_pairs(partitioned_sales(tx, card, tiers, with_all_eras), bucket, sigma)
    return solve_index(pair_statistics(pairs), bucket, base_min)


def price_level_index(tx: DataFrame, card: DataFrame, tiers: Sequence[str] = ("PSA10",)) -> DataFrame:
    """Plain weekly geometric-mean level per (era, tier), first week = 100.

    A second index series in the same shape, for comparisons and as a benchmark.
    """
    sales = partitioned_sales(tx, card, tiers)
    weekly = sales.groupBy(*PARTS, dates.week_monday(F.col("sold_at")).alias("period_start")).agg(
        F.avg(F.log("price_usd")).alias("level"), F.count(F.lit(1)).alias("n_pairs")
    )
    first = F.min_by("level", "period_start").over(Window.partitionBy(*PARTS))
    return weekly.select(
        "period_start",
        F.lit("NBA").alias("sport"),
        F.lit("weekly").alias("bucket"),
        "grade_tier",
        "era",
        (100 * F.exp(F.col("level") - first)).alias("index_value"),
        "n_pairs",
    )


def benchmark_weekly(bench: DataFrame) -> DataFrame:
    """Mean of an outside series per Monday week; ``bench`` has (date, value)."""
    return bench.groupBy(dates.week_monday(F.col("date")).alias("period_start")).agg(F.avg("value").alias("bench"))


def index_vs_benchmark(index: DataFrame, bench: DataFrame, min_periods: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of log levels and of log changes over shared weeks, for each series that ``by`` names."""
    both = (
        index.select(*by, "period_start", F.col("index_value").alias("ours"))
        .join(benchmark_weekly(bench), "period_start")
        .dropna(subset=["ours", "bench"])
        .select(*by, "period_start", F.log("ours").alias("a"), F.log("bench").alias("b"))
    )
    # One row per series and calendar week: an ordered window is small at any data size.
    order = Window.partitionBy(*by).orderBy("period_start")
    steps = both.select(*by, "a", "b", (F.col("a") - F.lag("a").over(order)).alias("da"), (F.col("b") - F.lag("b").over(order)).alias("db"))
    out = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("periods"), F.corr("a", "b").alias("level_corr"), F.corr("da", "db").alias("return_corr"))
    return out.where(F.col("periods") >= min_periods)

