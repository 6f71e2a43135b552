"""Market tables plus the derived tables that several queries read."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame

from slabmill.functions import dates
from slabmill.plans import catalyst, factors, index
from slabmill.session import stage
from slabmill.sources.bridge import Bridge

SALES_AS_OF = "2000-01-01"
EVENTS_AS_OF = "2024-01-25"

# The event log's JSON payload carries the expected weeks out under the key "k".
weeks_in_k = partial(catalyst.injury_weight, weeks_key="k")


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def forget() -> None:
    """Drop all derived tables, for timings that are to stand alone or where a source folder has changed."""
    _STORED.clear()


class Market(Bridge):
    @property
    def as_of(self):
        return dates.ts(SALES_AS_OF)

    @property
    def events_as_of(self):
        return dates.end_of_day(EVENTS_AS_OF)

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, written once per session and source folder, then read."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            _STORED[key] = stage(build(), name)
        return _STORED[key]

    @cached_property
    def factor_panel(self) -> DataFrame:
        """One row per card; targets, exits, features and reports all read it."""
        return self.stored("factor_panel", lambda: factors.factor_panel(self.tx_clean, self.card_master, self.as_of))

    @cached_property
    def level_index(self) -> DataFrame:
        return index.price_level_index(self.tx_clean, self.card_master)

    @cached_property
    def weekly_index(self) -> DataFrame:
        return self.stored("repeat_sales_index", lambda: index.repeat_sales_index(self.tx_clean, self.card_master))
