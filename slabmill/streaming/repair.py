"""Windows over a stream with repair: finished windows are kept in versions, late ones redone, open ones computed when asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType

from slabmill.session import hadoop_path, is_stored, stage

Summary = Callable[[DataFrame, Sequence[str]], DataFrame]


class WindowStore:
    """Summaries of rows by key and window, complete at any time, from a stream whose rows may come late by any amount.

    Below ``root``: ``rows`` (what has arrived, by micro-batch and the month of the window's start), ``finished`` (summaries, by the micro-batch that made them: its number is the
    version) and ``marks`` (after each micro-batch, the last window start that was finished). A window is finished when a row of ``late_days`` after its end
    has been seen. A micro-batch summarises the windows that it finishes, and once more each (key, window) that it brings late rows for; both read
    the months of those windows only, and of these the row groups that hold them. A micro-batch that is repeated after a failure overwrites what it left.
    """

    def __init__(self, spark: SparkSession, root: str, rows: StructType, keys: Sequence[str], ts: str, start: Column, days: int, late_days: int, summarise: Summary):
        self.spark, self.root, self.keys, self.ts, self.start = spark, root.rstrip("/"), list(keys), ts, start
        self.days, self.late_days, self.summarise = days, late_days, summarise
        self.by = [*self.keys, "window_start"]
        self._rows = StructType([*rows.fields, StructField("window_start", DateType()), StructField("batch", LongType()), StructField("month", DateType())])
        empty = spark.createDataFrame([], self._rows).drop("batch", "month")
        self._finished = StructType([*summarise(empty, self.by).schema.fields, StructField("version", LongType())])

    def _read(self, name: str, schema: StructType) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if is_stored(self.spark, path) else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, parts: Sequence[str]) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.root}/{name}")

    def rows(self) -> DataFrame:
        return self._read("rows", self._rows)

    def limit(self, before: int | None = None) -> date | None:
        """The last window start that is finished, after all micro-batches or before one of them."""
        marks = self._read("marks", StructType([StructField("last_start", DateType()), StructField("batch", LongType())]))
        if before is not None:
            marks = marks.where(F.col("batch") < before)
        return marks.agg(F.max("last_start")).first()[0]

    def take(self, batch: DataFrame, number: int) -> None:
        """Store one micro-batch, finish windows and repair those that its late rows belong to."""
        placed = batch.where(F.col(self.ts).isNotNull()).withColumn("window_start", self.start.cast("date"))
        placed = placed.withColumns({"batch": F.lit(number).cast("long"), "month": F.trunc("window_start", "month")}).select(*self._rows.names)
        self._drop("rows", "batch", number)
        self._write(placed.hint("rebalance", "month").sortWithinPartitions("month", "window_start"), "rows", ["batch", "month"])
        stored = self.rows()
        mine = stored.where(F.col("batch") == number)
        before = self.limit(number)
        reached = mine.agg(F.to_date(F.max(self.ts) - F.expr(f"interval {self.days + self.late_days} days"))).first()[0]
        after = max((d for d in (before, reached) if d is not None), default=None)
        done = self._between(stored, before, after) if after is not None else stored.where(F.lit(False))
        if before is not None:
            late = stage(self._between(mine, None, before).select(*self.by).distinct(), "late")
            days = [r[0] for r in late.select("window_start").distinct().collect()]  # no more than the calendar has windows
            if days:
                months = sorted({d.replace(day=1) for d in days})
                done = done.unionByName(stored.where(F.col("month").isin(months) & F.col("window_start").isin(days)).join(late, self.by, "left_semi"))
        done = done.drop("batch", "month")
        self._drop("finished", "version", number)
        self._write(self.summarise(done, self.by).withColumn("version", F.lit(number).cast("long")), "finished", ["version"])
        mark = self.spark.createDataFrame([(after, number)], "last_start date, batch long")
        self._write(mark, "marks", ["batch"])

    def _between(self, rows: DataFrame, after: date | None, upto: date | None) -> DataFrame:
        """Rows of windows that begin after one day and not after another; months outside are not read."""
        if after is not None:
            rows = rows.where((F.col("month") >= F.lit(after.replace(day=1))) & (F.col("window_start") > F.lit(after)))
        if upto is not None:
            rows = rows.where((F.col("month") <= F.lit(upto)) & (F.col("window_start") <= F.lit(upto)))
        return rows

    def _drop(self, name: str, part: str, number: int) -> None:
        """What an attempt at the same micro-batch may have left."""
        files, where = hadoop_path(self.spark, f"{self.root}/{name}/{part}={number}")
        files.delete(where, True)

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def finished(self) -> DataFrame:
        """The newest version of every finished summary."""
        held = self._read("finished", self._finished)
        rest = [c for c in held.columns if c not in (*self.by, "version")]
        newest = held.groupBy(*self.by).agg(F.max_by(F.struct(*rest), "version").alias("_row"))
        return newest.select(*self.by, "_row.*").select(*[c for c in held.columns if c != "version"])

    def open(self) -> DataFrame:
        """Summaries of the windows that aren't finished, from their own files only."""
        return self.summarise(self._between(self.rows(), self.limit(), None).drop("batch", "month"), self.by)

    def repaired(self) -> DataFrame:
        """Finished summaries that late rows have changed since they were first made."""
        versions = self._read("finished", self._finished).groupBy(*self.by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        return self.finished().join(versions, self.by, "left_semi")

    def view(self) -> DataFrame:
        """Every window's summary over all rows that have arrived."""
        return self.finished().unionByName(self.open())
