"""Every runnable query with, where SQL can say it, its independent SQL twin."""

from slabmill.catalog import (  # noqa: F401
    q_factors,
    q_io,
    q_portfolio,
    q_pricing,
    q_reports,
    q_scouting,
    q_text,
)
from slabmill.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
