"""Incremental versions of the batch operators; the column logic is the same."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from slabmill.functions.dates import month_start
from slabmill.operators.ordering import exact_quantiles
from slabmill.plans import parsing
from slabmill.sources.warehouse import Warehouse


def read_files(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Stream of the parquet files landing in ``folder``."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_files(stream: DataFrame, path: str, checkpoint: str, keyed: bool = False) -> StreamingQuery:
    """Append finished rows and stop when everything available is done; ``keyed``: with the state store that processors of keyed state need."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    if keyed:
        conf.set(STATE_STORE, ROCKS)
    try:  # a query takes the session's settings when it starts
        return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        if keyed:
            conf.set(STATE_STORE, before) if before else conf.unset(STATE_STORE)


def stream_parse(raw_stream: DataFrame, warehouse: Warehouse, checkpoint: str, sources=parsing.SOLD_SOURCES) -> StreamingQuery:
    """Parse pending rows of each micro-batch into clean sales and failures.

    Both writes skip known keys, so a batch replayed after a failure adds nothing.
    """

    def run(batch: DataFrame, _batch_id: int) -> None:
        clean, failed = parsing.parse_pending(
            batch, warehouse.read_table("tx_clean"), warehouse.read_table("parse_failures"), warehouse.read_table("card_master"), sources
        )
        warehouse.insert_if_absent(clean.withColumn("sold_month", month_start(F.col("sold_at")).cast("date")), "tx_clean")
        warehouse.insert_if_absent(failed, "parse_failures")

    return (
        raw_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_dedupe(raw_stream: DataFrame, late: str = "30 days") -> DataFrame:
    """First row per (source, external id) within the watermark; later repeats meet the keyed insert."""
    return raw_stream.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["source", "external_id"])


STATUS_OUTPUT = "player_id int, event_type string, at long, seq long"
WAITING = "event_type string, at long, seq long"


class StatusChanges(StatefulProcessor):
    """Keeps a player's reports until the watermark has passed them, then tells the changes in order of (time, sequence).

    The list holds only reports that the watermark hasn't reached, so a player's state is as long as the stream may be late. One timer a player stands
    at the earliest waiting report. ``at`` is in microseconds; timers and the watermark in milliseconds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", WAITING)
        self._last = handle.getValueState("last", "event_type string")
        self._due = handle.getValueState("due", "due long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        arrived = [(r["event_type"], r["at"], r["seq"]) for r in rows]
        self._waiting.appendList(arrived)
        self._wait_for(min(at for _, at, _ in arrived))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        held = list(self._waiting.get())
        ready = sorted((r for r in held if r[1] <= passed), key=lambda r: (r[1], r[2], r[0]))
        rest = [tuple(r) for r in held if r[1] > passed]
        self._due.clear()
        if rest:
            self._waiting.put(rest)
            self._wait_for(min(at for _, at, _ in rest))
        else:
            self._waiting.clear()
        last = self._last.get()[0] if self._last.exists() else None
        for kind, at, seq in ready:
            if kind != last and (last is not None or kind != "injury_return"):
                last = kind
                yield Row(player_id=key[0], event_type=kind, at=at, seq=seq)
        if last is not None:
            self._last.update((last,))

    def close(self) -> None:
        pass

    def _wait_for(self, at: int) -> None:
        """Stand the one timer at the earliest waiting report."""
        due = -(-at // 1000)
        if self._due.exists():
            (before,) = self._due.get()
            if before <= due:
                return
            self._handle.deleteTimer(before)
        self._handle.registerTimer(due)
        self._due.update((due,))


def stream_status_changes(reports: DataFrame, late: str = "2 days") -> DataFrame:
    """Reports that change a player's status, in order of time whatever the order in which they arrive within ``late``.

    A player's opening 'return' is not a change. Reports later than the watermark are dropped by the stream; reports it has not passed yet come out with a
    later micro-batch. Needs the state store that ``write_files(keyed=True)`` sets.
    """
    known = reports.where("player_id is not null and event_type is not null and event_date is not null")
    slim = known.withWatermark("event_date", late).select("player_id", "event_type", "event_date", F.unix_micros("event_date").alias("at"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"))
    changes = slim.groupBy("player_id").transformWithState(StatusChanges(), STATUS_OUTPUT, "append", "eventTime")
    return changes.select("player_id", "event_type", F.timestamp_micros("at").alias("event_date"), "seq")


def stream_weekly_price_levels(sales: DataFrame, late: str = "14 days") -> DataFrame:
    """Sales per card, Tuesday week and price; late sales beyond the watermark are left to repair."""
    week = F.window("sold_at", "7 days", "7 days", "5 days")
    return (
        sales.withWatermark("sold_at", late)
        .groupBy("card_id", week.alias("w"), "price_usd")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("card_id", F.col("w.start").alias("week_start"), "price_usd", "n")
    )


def weekly_medians_from_levels(levels: DataFrame) -> DataFrame:
    """Exact weekly medians from the price levels the stream has finished."""
    return exact_quantiles(levels, ["card_id", "week_start"], "price_usd", {"median_price": 0.5}, count_as="n_sales", weight="n")


def stream_daily_volume(sales: DataFrame, late: str = "7 days") -> DataFrame:
    """Sales per card and day; the 90-day roll-up over these rows is a batch window."""
    return (
        sales.withWatermark("sold_at", late)
        .groupBy("card_id", F.window("sold_at", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("volume"))
        .select("card_id", F.to_date("w.start").alias("date"), "volume")
    )
