"""Table sinks, cohort files and streaming queries, run on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slabmill.catalog.q_scouting import _frames
from slabmill.catalog.q_text import _catalogue, _done, _injury_feed, listing_titles
from slabmill.catalog.registry import query
from slabmill.functions import dates, event_text
from slabmill.operators.ordering import exact_quantiles
from slabmill.plans import events, pricing
from slabmill.session import scratch_path, stage
from slabmill.sources import cohorts
from slabmill.sources.warehouse import Warehouse, quantize
from slabmill.streaming import jobs, repair


def _warehouse(m):
    return Warehouse(m.spark, scratch_path(m.spark, "warehouse"))


@query("s01_read_missing_table", "select card_id, target_weight_pct from (select p_partkey card_id, 0.0::double target_weight_pct from part) x where 1 = 0")
def _(m):
    stored = _warehouse(m).read_table("portfolio_overrides").select("card_id", "target_weight_pct")
    return m.card_master.select("card_id").join(stored, "card_id")


@query("s01_read_table", "select source, external_id, raw_title, sold_at from tx_raw")
def _(m):
    wh = _warehouse(m)
    assert wh.read_table("tx_raw").isEmpty()
    wh.insert_if_absent(m.tx_raw, "tx_raw")
    return wh.read_table("tx_raw").select("source", "external_id", "raw_title", "sold_at")


@query("k01_insert_if_absent", """
select source, external_id, raw_title from tx_raw where cast(split_part(raw_id, '-', 3) as bigint) % 4 <> 3""")
def _(m):
    wh, part = _warehouse(m), F.split_part(F.col("raw_id"), F.lit("-"), F.lit(3)).cast("bigint") % 4
    wh.insert_if_absent(m.tx_raw.where(part <= 1), "tx_raw")
    wh.insert_if_absent(m.tx_raw.where(part <= 2).withColumn("raw_title", F.when(part == 2, F.col("raw_title")).otherwise("ignored")), "tx_raw")
    again = wh.insert_if_absent(m.tx_raw.where(part <= 2), "tx_raw")
    assert again == 0
    return wh.read_table("tx_raw").select("source", "external_id", "raw_title")


@query("k02_upsert", """
select card_id, grader, grade, case when card_id % 2 = 0 then pop_count + 1000 else pop_count end pop_count, cast(snapshot_date as date) snapshot_date from pop_snapshots""")
def _(m):
    wh = _warehouse(m)
    wh.upsert(m.pop_snapshots, "pop_snapshots")
    changed = m.pop_snapshots.where("card_id % 2 = 0").withColumn("pop_count", F.col("pop_count") + 1000)
    wh.upsert(changed.union(changed.withColumn("pop_count", F.col("pop_count") + 1)), "pop_snapshots", order=["pop_count"])
    return wh.read_table("pop_snapshots")


@query("k03_replace_slice", """
select card_id, date '1999-12-25' as_of_date, sales_count_90d, liquidity_tier from factor_panel union all select card_id, as_of_date, sales_count_90d, liquidity_tier from factor_panel where card_id % 2 = 0""")
def _(m):
    wh, panel = _warehouse(m), m.factor_panel
    wh.replace_slice(panel, "factor_panel")
    wh.replace_slice(panel.withColumn("as_of_date", F.lit("1999-12-25").cast("date")), "factor_panel")
    wh.replace_slice(panel.where("card_id % 2 = 0"), "factor_panel")
    gone = F.lit("1999-12-18").cast("date")
    wh.replace_slice(panel.withColumn("as_of_date", gone), "factor_panel")
    wh.replace_slice(panel.limit(0), "factor_panel", slices=[{"as_of_date": "1999-12-18"}])
    return wh.read_table("factor_panel").select("card_id", "as_of_date", "sales_count_90d", "liquidity_tier")


@query("k04_quantize", "select card_id, fair_value is not null and fair_value > 0 has_value, liquidity_margin_pct::decimal(6, 4)::double liquidity_margin_pct from trade_targets", liquidity_margin_pct=4)
def _(m):
    from slabmill.catalog.q_pricing import _targets

    out = quantize(m.stored("trade_targets", lambda: _targets(m)), pricing.TARGET_SCALES)
    assert dict(out.dtypes)["fair_value"] == "decimal(14,2)"
    return out.select("card_id", (F.col("fair_value") > 0).alias("has_value"), "liquidity_margin_pct")


@query("k05_write_cohort", "select br_slug, draft_year, usg_pct from ncaa where draft_year <> 2012 or usg_pct > 0", usg_pct=8)
def _(m):
    root, ncaa = scratch_path(m.spark, "cohort"), _frames(m)[0].select("br_slug", "usg_pct", "draft_year")
    cohorts.write_cohort(ncaa, root, "draft_year")
    cohorts.write_cohort(ncaa.where("draft_year = 2012 and usg_pct > 0"), root, "draft_year")
    return cohorts.read_cohort(m.spark, root, ncaa.schema, "draft_year")


@query("s08_read_cohort", "select br_slug, draft_year from ncaa where draft_year in (2011, 2013)")
def _(m):
    root, ncaa = scratch_path(m.spark, "cohort"), _frames(m)[0].select("br_slug", "usg_pct", "draft_year")
    cohorts.write_cohort(ncaa, root, "draft_year")
    return cohorts.read_cohort(m.spark, root, ncaa.schema, "draft_year", [2011, 2013, 2099]).select("br_slug", "draft_year")


# --- streams ------------------------------------------------------------------------------
def _stream_table(m, name):
    schema = m.raw(name).schema
    return jobs.read_files(m.spark, m.folder, schema, f"{name}.parquet")


def _finish(m, stream, label, keyed=False):
    out, state = scratch_path(m.spark, label), scratch_path(m.spark, f"{label}-state")
    jobs.write_files(stream, out, state, keyed).awaitTermination()
    return m.spark.read.schema(stream.schema).parquet(out)


def _sales_stream(m):
    return m.sales_from_lines(_stream_table(m, "lineitem"))


@query("st04_stream_weekly_medians", """
select * from weekly_medians where week_start + interval 7 day <= (select max(sold_at) from tx_clean) - interval 14 day""", median_price=8)
def _(m):
    levels = _finish(m, jobs.stream_weekly_price_levels(_sales_stream(m)), "weekly-levels")
    return jobs.weekly_medians_from_levels(levels)


@query("st05_stream_trailing_volume", """
select date, card_id, cast(coalesce(sum(volume) over (partition by card_id order by date range between interval 90 day preceding and interval 1 day preceding), 0) as bigint) trailing_volume
from (select cast(sold_at as date) as date, card_id, count(*) volume from tx_clean group by 1, 2) d
where date + interval 1 day <= (select max(sold_at) from tx_clean) - interval 7 day""")
def _(m):
    from slabmill.plans.portfolio import trailing_volume

    daily = _finish(m, jobs.stream_daily_volume(_sales_stream(m)), "daily-volume")
    return trailing_volume(daily).select("date", "card_id", "trailing_volume")


@query("st06_late_rows", """
select card_id, cast(sold_at as date) as date, count(*) volume from tx_clean group by 1, 2 having cast(sold_at as date) + interval 1 day > (select max(sold_at) from tx_clean) - interval 7 day""")
def _(m):
    return _daily_store(m).open().select("card_id", F.col("window_start").alias("date"), "volume")


def _repaired(m, label, start, days, late_days, summarise):
    """The sales of all time in three micro-batches: early ones, later ones, and every tenth sale only after those."""
    sales = m.tx_clean.select("tx_id", "card_id", "sold_at", "price_usd")
    landing, root, state = (scratch_path(m.spark, f"{label}{x}") for x in ("-landing", "", "-state"))
    tenth, early = F.pmod(F.xxhash64("tx_id"), F.lit(10)) == 0, F.col("sold_at") < dates.ts("1996-01-01")
    store = repair.WindowStore(m.spark, root, sales.schema, ["card_id"], "sold_at", start, days, late_days, summarise)
    for n, part in enumerate((~tenth & early, ~tenth & ~early, tenth)):  # a part is one micro-batch, of as many files as it has tasks
        sales.where(part).write.parquet(f"{landing}/{n}")
        stream = m.spark.readStream.schema(sales.schema).option("recursiveFileLookup", True).parquet(landing)
        store.run(stream, state).awaitTermination()
    return store


def _weekly(rows, keys):
    return exact_quantiles(rows, keys, "price_usd", {"median_price": 0.5}, count_as="n_sales")


def _volume(rows, keys):
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("volume"))


def _daily_store(m):
    return _repaired(m, "daily-store", F.col("sold_at").cast("date"), 1, 7, _volume)


@query("st04_weekly_medians_repaired", "select * from weekly_medians", median_price=8)
def _(m):
    week = dates.week_tuesday(F.col("sold_at")).cast("date")
    view = _repaired(m, "weekly-store", week, 7, 14, _weekly).view()
    return view.select("card_id", F.col("window_start").cast("timestamp").alias("week_start"), "n_sales", "median_price")


@query("st05_trailing_volume_repaired", """
select date, card_id, cast(coalesce(sum(volume) over (partition by card_id order by date range between interval 90 day preceding and interval 1 day preceding), 0) as bigint) trailing_volume
from (select cast(sold_at as date) as date, card_id, count(*) volume from tx_clean group by 1, 2) d""")
def _(m):
    from slabmill.plans.portfolio import trailing_volume

    daily = _daily_store(m).view().withColumnRenamed("window_start", "date")
    return trailing_volume(daily).select("date", "card_id", "trailing_volume")


@query("st02_stream_dedupe", "select count(distinct event_type || user_id) n from events")
def _(m):
    raw = _stream_table(m, "events").select(
        F.lit("feed").alias("source"), F.concat("event_type", F.col("user_id").cast("string")).alias("external_id"), F.col("ts").cast("timestamp").alias("ingested_at")
    )
    return _finish(m, jobs.stream_dedupe(raw, "60 days"), "dedupe").agg(F.count(F.lit(1)).alias("n"))


_CHANGES_SQL = """
with c as (select r.*, bool_or(event_type <> 'injury_return') over (partition by player_id order by event_date, seq) seen from injury_rows r),
u as (select *, lag(event_type) over (partition by player_id order by event_date, seq) lt from c where seen)
select player_id, event_type, event_date, seq from u where coalesce(lt, 'x') <> event_type"""


def _injury_reports(m):
    typed = _injury_feed(m).withColumn("event_type", event_text.classify_injury(F.col("status"))).where("event_type is not null")
    named = events.resolve_names(typed, m.player_master).where("player_id is not null")
    return stage(named.select("player_id", "event_type", F.col("status_date").cast("timestamp").alias("event_date"), F.col("seq").cast("long").alias("seq")), "reports")


def _changes_of(m, reports, batches, files_per_trigger, label, late="2 days"):
    """Run the stream over reports dealt into files by ``batches``; a closing row of nobody's lets the watermark pass the last report."""
    landing = scratch_path(m.spark, "landing")
    for batch in batches:
        reports.where(batch).coalesce(1).write.mode("append").parquet(landing)
    closing = reports.agg((F.max("event_date") + F.expr("interval 30 days")).alias("event_date"))
    closing.select(F.lit(-1).alias("player_id"), F.lit("closing").alias("event_type"), "event_date", F.lit(0).cast("long").alias("seq")).coalesce(1).write.mode("append").parquet(landing)
    stream = jobs.read_files(m.spark, landing, reports.schema, files_per_trigger=files_per_trigger)
    return _finish(m, jobs.stream_status_changes(stream, late), label, keyed=True)


@query("st03_stream_status_changes", _CHANGES_SQL)
def _(m):
    return _changes_of(m, _injury_reports(m), [F.lit(True)], 1000, "changes")


@query("u06_ordered_changes", _CHANGES_SQL)
def _(m):
    # The days of a block arrive in two files, each a micro-batch of its own, so that half of the reports come out of order.
    reports = _injury_reports(m)
    day = F.datediff("event_date", F.lit("1970-01-01"))
    span = reports.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    step = max(1, -(-(span["hi"] + 1 - span["lo"]) // 6))
    blocks = range(span["lo"], span["hi"] + 1, step)
    late_first = [(day >= b) & (day < b + step) & (F.col("seq") % 2 == odd) for b in blocks for odd in (1, 0)]
    return _changes_of(m, reports, late_first, 1, "ordered-changes", f"{step + 1} days")


@query("st01_stream_parse", """
select raw_id, card_id, slab_grader, method parser_method from resolved_titles where source = 'ebay' and confidence >= 0.5 and raw_price is not null
 and raw_id not in (select raw_id from done_rows)""")
def _(m):
    wh, landing = _warehouse(m), scratch_path(m.spark, "landing")
    raw = listing_titles(m).join(_done(m), "raw_id", "left_anti")
    raw.write.parquet(landing)
    wh.insert_if_absent(_catalogue(m), "card_master", ["card_id"])
    for _round in range(2):
        state = scratch_path(m.spark, "parse-state")
        jobs.stream_parse(jobs.read_files(m.spark, landing, raw.schema), wh, state).awaitTermination()
    return wh.read_table("tx_clean").select("raw_id", "card_id", "slab_grader", "parser_method")


