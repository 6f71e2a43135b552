"""Prices that hold until the next one, and net asset value from changes, against a day-by-day account."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slabmill.plans import portfolio

FIRST, DAYS, CARDS = date(2021, 1, 1), 60, 6


@pytest.fixture(scope="module")
def market():
    rng = np.random.default_rng(21)
    prices = [(FIRST + timedelta(int(d)), c, float(np.round(rng.uniform(1, 90), 2)) if rng.random() < 0.8 else None) for c in range(CARDS) for d in sorted(rng.choice(DAYS, 12, replace=False))]
    units = [(c, FIRST + timedelta(int(d)), float(rng.integers(0, 9))) for c in range(CARDS + 1) for d in sorted(rng.choice(DAYS, 4, replace=False))]
    return prices, units


def by_day(rows, key, day, value):
    """Day-by-day table of the last known value."""
    table = pd.DataFrame(index=[FIRST + timedelta(i) for i in range(DAYS)], columns=range(CARDS + 1), dtype=float)
    for r in rows:
        table.loc[r[day], r[key]] = np.nan if r[value] is None else r[value]
    return table.ffill()


def frame(spark, prices):
    return spark.createDataFrame([(d, c, p, 1) for d, c, p in prices], "date date, card_id long, mean_price double, volume long")


def test_spine_from_intervals(spark, market):
    prices, _ = market
    last = max(d for d, _, _ in prices)
    table = by_day(prices, 1, 0, 2)
    got = {(r.date, r.card_id): r.price for r in portfolio.locf_panel(frame(spark, prices)).collect()}
    want = {(d, c): table.loc[d, c] for d in table.index for c in table.columns if d <= last and not np.isnan(table.loc[d, c])}
    assert got == want
    day = FIRST + timedelta(30)
    assert {r.card_id: r.price for r in portfolio.prices_on(frame(spark, prices), F.lit(day)).collect()} == {c: p for (d, c), p in want.items() if d == day}
    plan = portfolio.locf_panel(frame(spark, prices))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == 1
    assert portfolio.locf_panel(frame(spark, prices).limit(0)).count() == 0


def test_net_asset_value_from_changes(spark, market):
    prices, units = market
    held = spark.createDataFrame([*units, (3, FIRST, None)], "card_id long, date date, units double").dropDuplicates(["card_id", "date"])
    cash = spark.createDataFrame([(FIRST + timedelta(i), 100.0 + i) for i in range(-3, DAYS + 5)], "date date, cash double")
    intervals = portfolio.price_intervals(frame(spark, prices))
    got = {r.date: r.nav for r in portfolio.mark_to_market(held, intervals, cash).collect()}
    worth = (by_day(units, 0, 1, 2) * by_day(prices, 1, 0, 2)).sum(axis=1)
    assert len(got) == DAYS + 8
    for i in range(-3, DAYS + 5):
        day = FIRST + timedelta(i)
        want = 100.0 + i + (worth[min(day, worth.index[-1])] if i >= 0 else 0.0)
        assert got[day] == pytest.approx(want, abs=1e-6)
    none = portfolio.mark_to_market(held.limit(0), intervals.limit(0), cash)
    assert {r.nav for r in none.collect()} == {100.0 + i for i in range(-3, DAYS + 5)}
