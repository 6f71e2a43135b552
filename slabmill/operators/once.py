"""Evaluate costly columns one time per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, *fields: Column) -> DataFrame:
    """Add struct ``name`` through a one-row generator.

    The optimizer merges neighbouring projections and so repeats an expression at
    every use; it does not look through a generator. Regex-heavy fields thus run
    once, and filters on them do not run them again.
    """
    return df.select("*", F.explode(F.array(F.struct(*fields))).alias(name))
