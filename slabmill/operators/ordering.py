"""Exact order statistics that never gather one key's rows in one task.

A value falls into a bucket that grows with the value. Bucket counts are few
per key, so their running sum gives every bucket's first rank; only the rows of
a single bucket are then ordered together. Equal values are counted before any
shuffle, so a price repeated a billion times travels as one row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabmill.session import reuse


def value_bucket(value: Column) -> Column:
    """Monotone bucket number of a double, about 1.6 % wide."""
    size = F.floor(F.log1p(F.abs(value) * 1000.0) * 64.0)
    return F.when(value >= 0, size).otherwise(-size - 1).cast("long")


def unit_bucket(width: float) -> Callable[[Column], Column]:
    """Equal-width buckets, for dates as day numbers and for ids."""
    return lambda value: F.floor(value / width).cast("long")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys meet NULL keys; the keys are kept once."""
    there = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    met = left.join(there, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)), how)
    return met.drop(*(f"_r_{k}" for k in keys))


def _value_counts(df: DataFrame, keys: Sequence[str], value: str, bucket, weight: str | None = None) -> DataFrame:
    size = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    return (
        df.select(*keys, F.col(value).cast("double").alias("_v"), size.alias("_w"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.sum("_w").alias("_n"))
        .withColumn("_b", bucket(F.col("_v")))
    )


def _bucket_edges(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    per_key = Window.partitionBy(*keys)
    return (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.sum("_bn").over(per_key.orderBy("_b")) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(per_key))
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    outputs: Mapping[str, float],
    count_as: str | None = None,
    bucket: Callable[[Column], Column] = value_bucket,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``keys`` (none = whole table).

    NULL values are not counted; a NULL key is a group like any other.

    ``weight`` names a column saying how many observations a row stands for.
    """
    keys = list(keys)
    counts = _value_counts(df, keys, value, bucket, weight)
    edges = _bucket_edges(counts, keys)
    last = F.col("_total") - 1

    def low(p: float) -> Column:
        return F.floor(last * F.lit(float(p)))

    def high(p: float) -> Column:
        return F.ceil(last * F.lit(float(p)))

    def covers(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    probs = sorted(set(outputs.values()))
    wanted = [covers(r(p), F.col("_before"), F.col("_bn")) for p in probs for r in (low, high)]
    edges = edges.where(reduce(or_, wanted))
    inside = _same(counts, edges, [*keys, "_b"]).withColumn(
        "_start",
        F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v")) - F.col("_n"),
    )
    picked = []
    for i, p in enumerate(probs):
        for tag, rank in (("lo", low(p)), ("hi", high(p))):
            hit = covers(rank, F.col("_start"), F.col("_n"))
            picked.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{i}"))
    found = inside.groupBy(*keys).agg(F.max("_total").alias("_total"), *picked)
    columns = []
    for name, p in outputs.items():
        i = probs.index(p)
        share = last * F.lit(float(p)) - low(p)
        columns.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share).alias(name))
    if count_as:
        columns.append(F.col("_total").alias(count_as))
    return found.select(*keys, *columns)


def count_below(
    df: DataFrame, value: str, parts: Sequence[str] = (), bucket: Callable[[Column], Column] = value_bucket
) -> DataFrame:
    """Add ``_below``, ``_same`` and ``_total``: rows of the partition under, at and with any value."""
    parts = list(parts)
    df = reuse(df)
    counts = _value_counts(df, parts, value, bucket)
    edges = _bucket_edges(counts, parts).drop("_bn")
    inner = Window.partitionBy(*parts, "_b").orderBy("_v")
    ranked = _same(counts, edges, [*parts, "_b"]).select(
        *parts, "_v", (F.col("_before") + F.sum("_n").over(inner) - F.col("_n")).alias("_below"), F.col("_n").alias("_same"), "_total"
    )
    keyed = df.withColumn("_v", F.col(value).cast("double"))
    return _same(keyed, ranked, [*parts, "_v"], "left").drop("_v")


def tie_percent_rank(
    df: DataFrame,
    value: str,
    out: str,
    parts: Sequence[str] = (),
    bucket: Callable[[Column], Column] = value_bucket,
) -> DataFrame:
    """Add tie-averaged rank / non-null count (pandas ``rank(pct=True)``)."""
    counted = count_below(df, value, parts, bucket)
    share = (F.col("_below") + (F.col("_same") + 1) / 2) / F.col("_total")
    return counted.withColumn(out, share).drop("_below", "_same", "_total")


def spread_row_number(
    df: DataFrame,
    out: str,
    value: str,
    tie: str,
    parts: Sequence[str] = (),
    descending: bool = False,
    count_as: str | None = None,
    tie_width: float = float(1 << 20),
) -> DataFrame:
    """``row_number`` over (parts ordered by value, NULL last, then tie) for partitions of any size.

    No row is dropped: NULL values, ties and partition keys are numbered like others, and ``count_as`` counts them.

    A row's number is the sum of three counts taken before it (lower buckets,
    lower values in its bucket, lower id ranges at its value) and its place among
    the few rows that share its value and id range.
    """
    parts = list(parts)
    sign = -1.0 if descending else 1.0
    df = reuse(
        df.withColumn("_o", F.col(value).cast("double") * F.lit(sign))
        .withColumn("_b0", value_bucket(F.col("_o")))
        .withColumn("_b1", unit_bucket(tie_width)(F.col(tie)))
    )
    coarse = df.groupBy(*parts, "_b0").agg(F.count(F.lit(1)).alias("_n0"))
    per_part = Window.partitionBy(*parts)
    coarse = coarse.select(
        *parts,
        "_b0",
        (F.sum("_n0").over(per_part.orderBy(F.asc_nulls_last("_b0"))) - F.col("_n0")).alias("_s0"),
        F.sum("_n0").over(per_part).alias("_all"),
    )
    shared = df.groupBy(*parts, "_b0", "_o").agg(F.count(F.lit(1)).alias("_nv"))
    shared = shared.withColumn(
        "_sv", F.sum("_nv").over(Window.partitionBy(*parts, "_b0").orderBy(F.asc_nulls_last("_o"))) - F.col("_nv")
    ).drop("_nv")
    by_id = df.groupBy(*parts, "_o", "_b1").agg(F.count(F.lit(1)).alias("_ni"))
    by_id = by_id.withColumn(
        "_si", F.sum("_ni").over(Window.partitionBy(*parts, "_o").orderBy(F.asc_nulls_last("_b1"))) - F.col("_ni")
    ).drop("_ni")
    ranked = (
        _same(_same(_same(df, coarse, [*parts, "_b0"]), shared, [*parts, "_b0", "_o"]), by_id, [*parts, "_o", "_b1"])
        .withColumn("_r", F.row_number().over(Window.partitionBy(*parts, "_o", "_b1").orderBy(F.asc_nulls_last(tie))))
        .withColumn(out, (F.col("_s0") + F.col("_sv") + F.col("_si") + F.col("_r")).cast("long"))
    )
    if count_as:
        ranked = ranked.withColumn(count_as, F.col("_all"))
    return ranked.drop("_o", "_b0", "_b1", "_s0", "_sv", "_si", "_r", "_all")
