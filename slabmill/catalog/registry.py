"""Registration of queries and assembly of their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabmill.catalog.market import Market

TIE_SHIFT = 0.01371
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Define a named subquery usable by any SQL twin."""
    _VIEWS[name] = sql.strip()


def query(name: str, sql: str | None = None, **decimals: int):
    """Register a function of a Market; ``decimals`` rounds float columns on both sides.

    Engines disagree on which way an exact tie goes, so both sides shift by about
    1 % of the last digit before rounding.
    """

    def register(build: Callable[[Market], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = build(Market(spark, folder))
            for column, places in decimals.items():
                df = df.withColumn(column, F.round(F.col(column).cast("double") + TIE_SHIFT * 10.0**-places, places))
            return df

        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if decimals:
                parts = ", ".join(f"round(cast({c} as double) + {TIE_SHIFT * 10.0**-n!r}::double, {n}) as {c}" for c, n in decimals.items())
                body = f"select * replace ({parts}) from ({body}) final_rows"
            _SQL[name] = body
        return build

    return register


def _needed(sql: str, seen: list[str]) -> None:
    for word in dict.fromkeys(re.findall(r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)", sql)):
        if word in _VIEWS and word not in seen:
            _needed(_VIEWS[word], seen)
            if word not in seen:
                seen.append(word)


def with_views(sql: str) -> str:
    needed: list[str] = []
    _needed(sql, needed)
    if not needed:
        return sql
    views = ",\n".join(f"{n} as ({_VIEWS[n]})" for n in needed)
    if sql[:5].lower() == "with ":
        return f"with {views},\n{sql[5:]}"
    return f"with {views}\n{sql}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _SQL.items()}
