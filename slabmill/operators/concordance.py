"""Concordant pairs inside groups, counted without forming a single pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slabmill.operators.ordering import count_below, value_bucket


def concordance(df: DataFrame, target: str, score: str, groups: Sequence[str]) -> DataFrame:
    """Per group: ``agree`` (pairs ordered alike) and ``comparable`` (pairs with unequal target).

    Two rows with different scores have score ranks that first differ in one binary
    digit. For every digit, rows sharing the higher digits split into a low and a
    high side; each high row agrees with the low rows of smaller target, and that
    number is a running count. Work grows as n log n, spread over digits, prefixes
    and target buckets.
    """
    groups = list(groups)
    ranked = count_below(df.select(*groups, F.col(target).cast("double").alias("_y"), F.col(score).alias("_s")), "_s", groups)
    digits = ranked.where(F.col("_y").isNotNull() & F.col("_below").isNotNull()).select(
        *groups, "_y", "_below", F.explode(F.sequence(F.lit(0), F.length(F.bin("_total")) - 1)).alias("_l")
    )
    sides = digits.select(
        *groups,
        "_y",
        "_l",
        F.expr("shiftright(_below, _l + 1)").alias("_p"),
        F.expr("shiftright(_below, _l) & 1").alias("_hi"),
    )
    node = [*groups, "_l", "_p"]
    counts = sides.groupBy(*node, "_y").agg(
        F.count(F.when(F.col("_hi") == 0, 1)).alias("_n0"), F.count(F.when(F.col("_hi") == 1, 1)).alias("_n1")
    ).withColumn("_b", value_bucket(F.col("_y")))
    coarse = counts.groupBy(*node, "_b").agg(F.sum("_n0").alias("_bn"))
    coarse = coarse.withColumn("_before", F.sum("_bn").over(Window.partitionBy(*node).orderBy("_b")) - F.col("_bn")).drop("_bn")
    inner = Window.partitionBy(*node, "_b").orderBy("_y")
    joined = counts.join(coarse, [*node, "_b"]).withColumn(
        "_lower", F.col("_before") + F.sum("_n0").over(inner) - F.col("_n0")
    )
    agree = joined.groupBy(*groups).agg(F.sum(F.col("_n1") * F.col("_lower")).cast("bigint").alias("agree"))
    same = df.groupBy(*groups, target).agg(F.count(F.lit(1)).alias("_t")).where(F.col(target).isNotNull())
    pairs = lambda n: n * (n - 1) / 2
    comparable = same.groupBy(*groups).agg(
        (pairs(F.sum("_t")) - F.sum(pairs(F.col("_t")))).cast("bigint").alias("comparable")
    )
    return comparable.join(agree, groups, "left").select(*groups, F.coalesce("agree", F.lit(0)).alias("agree"), "comparable")


def concordance_share(df: DataFrame, target: str, score: str, groups: Sequence[str]) -> DataFrame:
    """One row: agreeing share of all comparable pairs, NULL when there are none."""
    per_group = concordance(df, target, score, groups)
    return per_group.agg((F.sum("agree") / F.nullif(F.sum("comparable"), F.lit(0))).alias("concordance"))
