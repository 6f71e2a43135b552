"""Partitioned cohort tables: reading, latest snapshots, normalising, writing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabmill.session import is_stored


def normalize_frame(df: DataFrame, schema: T.StructType, defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """Project to ``schema``: missing columns added, values cast where they can be, NULLs defaulted."""
    defaults = defaults or {}
    have = set(df.columns)
    columns = []
    for field in schema.fields:
        value = F.col(field.name).try_cast(field.dataType) if field.name in have else F.lit(None).cast(field.dataType)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def read_cohort(spark: SparkSession, root: str, schema: T.StructType, key: str, values: Sequence | None = None) -> DataFrame:
    """Cohort rows of the wanted partitions; absent partitions are simply not there."""
    if not is_stored(spark, root):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(root)
    return df if values is None else df.where(F.col(key).isin(*values))


def latest_snapshots(df: DataFrame, as_of, keys: Sequence[str] = ("source",), date: str = "snapshot_date") -> DataFrame:
    """Rows of each key's newest snapshot on or before ``as_of``.

    The newest dates are one row per source; once small, they prune date partitions.
    """
    known = df.where(F.col(date) <= as_of)
    newest = known.groupBy(*keys).agg(F.max(date).alias(date))
    return known.join(newest, [*keys, date], "left_semi")


def latest_snapshot_scan(spark: SparkSession, root: str, schema: T.StructType, draft_year: int, as_of) -> DataFrame:
    df = read_cohort(spark, root, schema, "draft_year", [draft_year])
    return latest_snapshots(df, as_of)


def write_cohort(df: DataFrame, root: str, *partitions: str) -> None:
    """Replace the partitions present in ``df`` and leave the others alone.

    A row hash joins the partition columns, so one big partition is written by many tasks.
    """
    (
        df.repartition(*[F.col(p) for p in partitions], F.pmod(F.xxhash64(*df.columns), F.lit(64)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(root)
    )


def merge_on_shared_keys(base: DataFrame, extra: DataFrame, candidates: Sequence[str] = ("name", "team", "tm"), suffix: str = "_adv"):
    """Left join on whichever candidate keys both frames have; clashing columns get a suffix."""
    lower = lambda df: df.toDF(*[("name" if c.lower() == "player" else c.lower()) for c in df.columns])
    base, extra = lower(base), lower(extra)
    keys = [k for k in candidates if k in base.columns and k in extra.columns]
    if not keys:
        return base
    extra = extra.select(*[F.col(c) if c in keys or c not in base.columns else F.col(c).alias(c + suffix) for c in extra.columns])
    return base.join(extra, keys, "left")
