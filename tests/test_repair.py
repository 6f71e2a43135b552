"""Windows over a stream with repair against the whole batch, out-of-order and repeated micro-batches included."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabmill.streaming import jobs, repair

FIRST = datetime(2023, 1, 1)


def total(rows, keys):
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").alias("x"))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(31)
    return [(int(rng.integers(0, 5)), FIRST + timedelta(minutes=int(rng.integers(0, 60 * 24 * 40))), int(rng.integers(0, 100))) for _ in range(900)]


def store_of(spark, root):
    schema = spark.createDataFrame([], "k int, ts timestamp, x long").schema
    return repair.WindowStore(spark, str(root), schema, ["k"], "ts", F.col("ts").cast("date"), 1, 3, total)


def brute(rows):
    found = {}
    for k, ts, x in rows:
        n, s = found.get((k, ts.date()), (0, 0))
        found[k, ts.date()] = (n + 1, s + x)
    return found


def seen(df):
    return {(r.k, r.window_start): (r.n, r.x) for r in df.collect()}


def test_view_equals_the_batch_after_each_micro_batch(spark, rows, tmp_path):
    store = store_of(spark, tmp_path / "w")
    assert store.view().count() == 0 and store.limit() is None
    half = FIRST + timedelta(days=20)
    parts = [[r for r in rows if r[1] < half and r[2] % 4], [r for r in rows if r[1] >= half and r[2] % 4], [r for r in rows if r[2] % 4 == 0] + [(9, None, 1)]]
    so_far = []
    for number, part in enumerate(parts):
        frame = spark.createDataFrame(part, "k int, ts timestamp, x long")
        store.take(frame, number)
        so_far += [r for r in part if r[1]]
        if number == 1:
            store.take(frame.limit(5), number)  # an attempt that saw less ...
            store.take(frame, number)  # ... is replaced by the next one
        if number:
            assert seen(store.view()) == brute(so_far)
        newest = max(r[1] for r in so_far)
        assert store.limit() == (newest - timedelta(days=4)).date()
    limit = store.limit()
    assert {d for _, d in seen(store.open())} == {r[1].date() for r in so_far if r[1].date() > limit}
    late = {(k, ts.date()) for k, ts, x in rows if x % 4 == 0}
    early = {(k, ts.date()) for k, ts, x in rows if x % 4}
    assert set(seen(store.repaired())) == {(k, d) for k, d in late & early if d <= (max(r[1] for r in parts[1]) - timedelta(days=4)).date()}
    plan = store.open()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(window_start), GreaterThan(window_start" in plan


def test_each_stream_run_goes_on_where_the_last_one_stopped(spark, rows, tmp_path):
    store, landing = store_of(spark, tmp_path / "w"), str(tmp_path / "landing")
    schema = spark.createDataFrame([], "k int, ts timestamp, x long").schema
    order = sorted(rows, key=lambda r: (r[2] % 7, r[1]))
    for at in (0, 450):
        spark.createDataFrame(order[at : at + 450], schema).coalesce(1).write.mode("append").parquet(landing)
        store.run(jobs.read_files(spark, landing, schema, files_per_trigger=1), str(tmp_path / "state")).awaitTermination()
    assert seen(store.view()) == brute(order)


def reports():
    rng = np.random.default_rng(32)
    kinds = ["injury_out", "injury_dtd", "injury_return"]
    return [(int(rng.integers(0, 4)), str(rng.choice(kinds)), FIRST + timedelta(hours=int(rng.integers(0, 24 * 12))), i) for i in range(300)]


def test_changes_leave_in_order_whatever_the_order_of_arrival(spark, tmp_path):
    known, out, state, landing = reports(), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "landing")
    schema = spark.createDataFrame([], "player_id int, event_type string, event_date timestamp, seq long").schema
    rng = np.random.default_rng(33)
    arrival = sorted(known, key=lambda r: r[2] + timedelta(hours=float(rng.uniform(0, 47))))  # at most 47 hours late
    arrival.append((None, "injury_out", FIRST, 0))
    closing = [(-1, "closing", FIRST + timedelta(days=60), 0)]
    for part in (arrival[:120], arrival[120:], closing):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = jobs.stream_status_changes(jobs.read_files(spark, landing, schema, files_per_trigger=1), "2 days")
        jobs.write_files(stream, out, state, keyed=True).awaitTermination()  # a restart between any two files
    want, last = set(), {}
    for player, kind, at, seq in sorted(known, key=lambda r: (r[0], r[2], r[3])):
        before = last.get(player)
        if kind != before and (before or kind != "injury_return"):
            want.add((player, kind, at, seq))
            last[player] = kind
    got = {tuple(r) for r in spark.read.parquet(out).select("player_id", "event_type", "event_date", "seq").collect()}
    assert got == want and spark.conf.get(jobs.STATE_STORE) != jobs.ROCKS
