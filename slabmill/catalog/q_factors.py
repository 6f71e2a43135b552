"""Filters, weekly buckets, momentum, liquidity, index and event-score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slabmill.catalog.market import EVENTS_AS_OF, weeks_in_k
from slabmill.catalog.registry import query, view
from slabmill.functions import cards, dates
from slabmill.operators.asof import asof_slice, asof_slice_closed
from slabmill.plans import catalyst, factors, index

# --- market tables as SQL ----------------------------------------------------
view("player_master", """
select cast(s_suppkey as int) player_id, s_name as name, n_name as team, cast(1975 + s_suppkey % 25 as int) draft_year,
 cast(1 + s_suppkey % 60 as int) draft_pick,
 make_date(cast(1955 + s_suppkey % 25 as int), cast(1 + s_suppkey % 12 as int), cast(1 + s_suppkey % 28 as int)) dob
from supplier join nation on s_nationkey = n_nationkey""")
view("card_master", """
select p_partkey card_id, cast(1995 + p_partkey % 30 as int) as card_year, p_brand manufacturer, p_type set_name,
 cast(p_partkey as varchar) card_number, split_part(p_name, ' ', 1) parallel, case when p_size <= 25 then p_size end print_run,
 cast(p_partkey % 10 as int) player_id, p_size <= 10 is_rookie, p_type = 'PROMO' has_auto, p_size % 7 = 0 has_patch,
 p_size = 1 is_one_of_one
from part""")
view("tx_clean", """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) tx_id,
 l_partkey card_id, l_shipdate sold_at, l_extendedprice / l_quantity price_usd,
 case l_returnflag when 'A' then 'PSA' when 'R' then 'BGS' end slab_grader,
 case when l_returnflag <> 'N' then cast(6 + l_linenumber % 5 as double) end slab_grade,
 concat_ws('-', l_partkey, l_suppkey) cert_number, l_extendedprice * l_tax / l_quantity fee_estimate
from lineitem""")
view("tx_raw", """
select t.tx_id raw_id, case when t.slab_grader is null then 'ebay_active' else 'ebay' end as source,
 concat_ws(' ', c.card_year, 'Panini', 'Prizm', c.parallel, concat('#', c.card_number),
  case when t.slab_grader is not null then concat(t.slab_grader, ' ', cast(cast(t.slab_grade as int) as varchar)) end) raw_title,
 t.price_usd raw_price, t.sold_at, t.tx_id external_id, concat('{"search_query":"', c.manufacturer, '"}') raw_json,
 t.sold_at + interval 1 day ingested_at
from tx_clean t join card_master c on c.card_id = t.card_id""")
view("player_events", """
select event_id, cast(user_id % 10 as int) player_id,
 case event_type when 'purchase' then 'mvp' when 'signup' then 'all_star' when 'view' then 'playoff_win'
  when 'click' then 'signed' else 'injury_out' end as event_type, ts as event_date, props event_payload
from events""")
view("pop_snapshots", """
select snapshot_date, card_id, grader, grade,
 cast(sum(n) over (partition by card_id, grader, grade order by snapshot_date) as bigint) pop_count
from (select date_trunc('month', sold_at) as snapshot_date, card_id, slab_grader as grader, slab_grade as grade, count(*) n
      from tx_clean where slab_grader = 'PSA' group by 1, 2, 3, 4) g""")
view("portfolio_holdings", """
select o_orderkey holding_id, o_orderkey % 200 card_id, o_orderdate acquired_at, o_totalprice / 10 acquired_cost_usd,
 case when o_orderstatus = 'F' then 'sold' else 'held' end as status, cast(1 + o_orderkey % 10 as int) entry_factor_decile,
 substr('ABCD', cast(1 + o_orderkey % 4 as int), 1) entry_liquidity_tier
from orders""")
view("prospects", """
select c_name br_slug, cast(2010 + c_custkey % 15 as int) draft_year,
 case when c_custkey % 5 <> 0 then cast(1 + c_custkey % 60 as int) end draft_pick,
 case c_custkey % 3 when 0 then 'NCAA' when 1 then 'GLEAGUE' else 'EUROLEAGUE' end prospect_origin,
 c_acctbal / 400 usg_pct, greatest(c_acctbal, 0.0) / 300 career_bpm_5y
from customer""")
view("mock_ranks", """
select s.source, c_name br_slug, 2026 as draft_year, cast(1 + (c_custkey * s.k) % 97 as int) as mock_rank
from customer cross join (values ('a', 3), ('b', 5), ('c', 7), ('d', 11)) s(source, k) where (c_custkey + s.k) % 4 <> 0""")

AS_OF = "timestamp '2000-01-01'"
EV_OF = f"(timestamp '{EVENTS_AS_OF}' + interval 1 day - interval 1 microsecond)"

# --- momentum, liquidity ------------------------------------------------------
view("weekly_medians", """
select card_id, date_trunc('week', sold_at - interval 1 day) + interval 1 day week_start, median(price_usd) median_price,
 count(*) n_sales from tx_clean group by 1, 2""")
view("mom_hist", f"select * from tx_clean where sold_at < {AS_OF} and sold_at >= {AS_OF} - interval 400 day")
view("mom_weekly", """
select card_id, date_trunc('week', sold_at - interval 1 day) + interval 1 day wk, median(price_usd) p, count(*) n
from mom_hist group by 1, 2""")
view("mom_returns", f"""
select card_id, {', '.join(f'''case when count(*) filter (wk >= {AS_OF} - interval {d} day) >= 2
  and min_by(p, wk) filter (wk >= {AS_OF} - interval {d} day) > 0
  then max_by(p, wk) filter (wk >= {AS_OF} - interval {d} day) / min_by(p, wk) filter (wk >= {AS_OF} - interval {d} day) - 1 end r{d}'''
  for d in (30, 90, 365))} from mom_weekly group by card_id""")
view("mom_hype", f"""
select card_id, median(price_usd) filter (sold_at >= {AS_OF} - interval 7 day)
 / median(price_usd) filter (sold_at < {AS_OF} - interval 7 day and sold_at >= {AS_OF} - interval 30 day) - 1 jump
from mom_hist group by card_id""")
view("mom_counts", f"""
select card_id, count(*) sales_count_lookback from mom_hist where sold_at >= {AS_OF} - interval 90 day group by card_id""")
view("momentum_panel", """
select c.card_id, r30, r90, r365,
 case when c.sales_count_lookback >= 3 and r90 is not null then
  (rank() over (partition by (c.sales_count_lookback >= 3 and r90 is not null) order by r90)
   + (count(*) over (partition by (c.sales_count_lookback >= 3 and r90 is not null), r90) - 1) / 2.0)
  / count(*) over (partition by (c.sales_count_lookback >= 3 and r90 is not null)) end cs_momentum_pct,
 coalesce(jump > 1, false) is_hyped, c.sales_count_lookback
from mom_counts c left join mom_returns r on r.card_id = c.card_id left join mom_hype h on h.card_id = c.card_id""")
view("liquidity_panel", f"""
select u.card_id, coalesce(n, 0) sales_count_90d, coalesce(v, 0.0) dollar_volume_90d,
 case when npsa >= 3 and md > 0 then (hi - lo) / md end bid_ask_proxy,
 cast(greatest(floor(date_diff('second', last_sold, {AS_OF}) / 86400.0), 0) as int) last_sale_recency_days,
 case when coalesce(n, 0) >= 10 then 'A' when coalesce(n, 0) >= 3 then 'B' when coalesce(n, 0) >= 1 then 'C' else 'D' end liquidity_tier
from card_master u left join (
 select card_id, max(sold_at) last_sold, count(*) filter (sold_at >= {AS_OF} - interval 90 day) n,
  sum(price_usd) filter (sold_at >= {AS_OF} - interval 90 day) v,
  count(*) filter (sold_at >= {AS_OF} - interval 90 day and slab_grader = 'PSA') npsa,
  quantile_cont(price_usd, 0.1) filter (sold_at >= {AS_OF} - interval 90 day and slab_grader = 'PSA') lo,
  quantile_cont(price_usd, 0.5) filter (sold_at >= {AS_OF} - interval 90 day and slab_grader = 'PSA') md,
  quantile_cont(price_usd, 0.9) filter (sold_at >= {AS_OF} - interval 90 day and slab_grader = 'PSA') hi
 from tx_clean where sold_at < {AS_OF} group by card_id) t on t.card_id = u.card_id""")
view("factor_panel", f"""
select l.*, r30, r90, r365, cs_momentum_pct, coalesce(is_hyped, false) is_hyped, sales_count_lookback,
 cast({AS_OF} as date) as_of_date
from liquidity_panel l left join momentum_panel m on m.card_id = l.card_id""")

MOM = {"r30": 6, "r90": 6, "r365": 6, "cs_momentum_pct": 6}
LIQ = {"dollar_volume_90d": 2, "bid_ask_proxy": 6}


@query("d04_liquidity_panel", "select * from liquidity_panel", **LIQ)
def _(m):
    return factors.liquidity_panel(m.tx_clean, m.card_master, m.as_of)


@query("d03_momentum_panel", "select * from momentum_panel", **MOM)
def _(m):
    return factors.momentum_panel(m.tx_clean, m.as_of)


@query("d05_factor_panel", "select * from factor_panel", **MOM, **LIQ)
def _(m):
    return factors.factor_panel(m.tx_clean, m.card_master, m.as_of)


@query("w06_volume_weighted_returns", f"""
with w as (select *, row_number() over (partition by card_id order by wk) a, row_number() over (partition by card_id order by wk desc) z,
  count(*) over (partition by card_id) c from mom_weekly where wk >= {AS_OF} - interval 365 day),
k as (select *, least(2, greatest(1, c // 2)) kk from w),
e as (select card_id, max(c) c, sum(p * n) filter (a <= kk) / sum(n) filter (a <= kk) s,
  sum(p * n) filter (z <= kk) / sum(n) filter (z <= kk) t from k group by card_id)
select m.card_id, case when c >= 2 and s > 0 then t / s - 1 end r365 from mom_counts m left join e on e.card_id = m.card_id""", r365=6)
def _(m):
    return factors.momentum_panel(m.tx_clean, m.as_of, volume_weight=True).select("card_id", "r365")


@query("a01_weekly_median", "select * from weekly_medians", median_price=8)
def _(m):
    return factors.weekly_medians(m.tx_clean)


@query("a02_sales_in_lookback", "select * from mom_counts")
def _(m):
    sliced = asof_slice(m.tx_clean, "sold_at", m.as_of, 90)
    return sliced.groupBy("card_id").agg(F.count(F.lit(1)).alias("sales_count_lookback"))


@query("a03_recent_vs_prior_median", "select card_id, jump from mom_hype where jump is not null", jump=6)
def _(m):
    hist = asof_slice(m.tx_clean, "sold_at", m.as_of, 400)
    stats = factors._price_stats(hist, m.as_of).groupBy("card_id").agg(
        F.max(F.when(F.col("kind") == 1, F.col("median_price"))).alias("recent"),
        F.max(F.when(F.col("kind") == 2, F.col("median_price"))).alias("prior"),
    )
    return stats.select("card_id", (F.col("recent") / F.col("prior") - 1).alias("jump")).where("jump is not null")


@query("a04_count_and_volume", f"""
select card_id, count(*) sales_count_90d, sum(price_usd) dollar_volume_90d from tx_clean
where sold_at < {AS_OF} and sold_at >= {AS_OF} - interval 90 day group by card_id""", dollar_volume_90d=2)
def _(m):
    return factors.sales_activity(m.tx_clean, m.as_of).where("sales_count_90d > 0").drop("last_sold_at")


@query("a05_spread_proxy", "select card_id, bid_ask_proxy from liquidity_panel where bid_ask_proxy is not null", bid_ask_proxy=6)
def _(m):
    return factors.spread_proxy(m.tx_clean, m.as_of).where("bid_ask_proxy is not null")


@query("a06_last_activity", f"""
select card_id, max(sold_at) last_sold_at, cast(greatest(floor(date_diff('second', max(sold_at), {AS_OF}) / 86400.0), 0) as int) recency_days
from tx_clean where sold_at < {AS_OF} group by card_id""")
def _(m):
    last = asof_slice(m.tx_clean, "sold_at", m.as_of).groupBy("card_id").agg(F.max("sold_at").alias("last_sold_at"))
    return last.withColumn("recency_days", F.greatest(dates.whole_days(m.as_of, F.col("last_sold_at")), F.lit(0)))


@query("w02_tie_percent_rank", """
select card_id, sales_count_90d, (rank() over (order by sales_count_90d) + (count(*) over (partition by sales_count_90d) - 1) / 2.0)
 / count(*) over () pct from liquidity_panel""", pct=8)
def _(m):
    from slabmill.operators.ordering import tie_percent_rank

    counts = factors.sales_activity(m.tx_clean, m.as_of).select("card_id", "sales_count_90d")
    full = m.card_master.select("card_id").join(counts, "card_id", "left").fillna(0, ["sales_count_90d"])
    return tie_percent_rank(full, "sales_count_90d", "pct")


# --- filters -------------------------------------------------------------------
@query("p01_filter_grade", """
select 'PSA10' tier, count(*) n from tx_clean where slab_grader = 'PSA' and slab_grade = 10 union all
select 'PSA9', count(*) from tx_clean where slab_grader = 'PSA' and slab_grade = 9 union all
select 'PSA8', count(*) from tx_clean where slab_grader = 'PSA' and slab_grade = 8 union all
select 'lower', count(*) from tx_clean where slab_grader is not null and slab_grade < 8 union all
select 'all', count(*) from tx_clean""")
def _(m):
    members = cards.grade_memberships(F.col("slab_grader"), F.col("slab_grade"))
    return m.tx_clean.select(F.explode(members).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("p01_filter_grade_lower", "select tx_id, price_usd from tx_clean where slab_grader is not null and slab_grade < 8", price_usd=8)
def _(m):
    return index.filter_grade(m.tx_clean, "lower").select("tx_id", "price_usd")


@query("p02_filter_era", """
select c.card_id, count(*) n from tx_clean t join card_master c on c.card_id = t.card_id
where card_year >= 2010 and cert_number is not null group by 1""")
def _(m):
    joined = m.tx_clean.join(m.card_master.select("card_id", "card_year"), "card_id")
    return index.filter_era(joined, "modern").groupBy("card_id").agg(F.count(F.lit(1)).alias("n"))


@query("p03_asof_slice", f"select tx_id, sold_at from tx_clean where sold_at < {AS_OF} and sold_at >= {AS_OF} - interval 90 day")
def _(m):
    return asof_slice(m.tx_clean, "sold_at", m.as_of, 90).select("tx_id", "sold_at")


@query("p04_asof_slice_closed", f"select tx_id, sold_at from tx_clean where sold_at <= {AS_OF} and sold_at >= {AS_OF} - interval 90 day")
def _(m):
    return asof_slice_closed(m.tx_clean, "sold_at", m.as_of, 90).select("tx_id", "sold_at")


# --- index ------------------------------------------------------------------------
view("index_sales", """
select tx_id, cert_number, sold_at, price_usd, case when card_year >= 2010 then 'modern' else 'vintage' end era,
 case when slab_grader = 'PSA' and slab_grade = 10 then 'PSA10' when slab_grader = 'PSA' and slab_grade = 9 then 'PSA9'
  when slab_grader = 'PSA' and slab_grade = 8 then 'PSA8' when slab_grader is not null and slab_grade < 8 then 'lower' end grade_tier
from tx_clean t join card_master c on c.card_id = t.card_id where cert_number is not null""")
view("pairs_raw", """
select * from (select era, grade_tier, cert_number, sold_at t0, lead(sold_at) over w t1,
  date_trunc('week', sold_at) bucket0, date_trunc('week', lead(sold_at) over w) bucket1, price_usd price0, lead(price_usd) over w price1
 from index_sales where grade_tier is not null
 window w as (partition by era, grade_tier, cert_number order by sold_at, tx_id, price_usd)) p
where t1 is not null and bucket0 <> bucket1 and price0 > 0 and price1 > 0""")
view("index_pairs", """
select p.*, ln(price1 / price0) log_return from pairs_raw p join (
 select era, grade_tier, count(*) n, avg(ln(price1 / price0)) mu, stddev_pop(ln(price1 / price0)) sg from pairs_raw group by 1, 2) s
 on s.era = p.era and s.grade_tier = p.grade_tier
where n <= 1 or sg <= 0 or abs(ln(price1 / price0) - mu) <= 3 * sg""")
PAIR = {"price0": 8, "price1": 8, "log_return": 6}


@query("w01_consecutive_pairs", "select *, ln(price1 / price0) log_return from pairs_raw", **PAIR)
def _(m):
    return index.consecutive_pairs(index.partitioned_sales(m.tx_clean, m.card_master))


@query("d01_build_pairs", "select * from index_pairs", **PAIR)
def _(m):
    return index.build_pairs(index.partitioned_sales(m.tx_clean, m.card_master))


@query("a15_pair_statistics", """
select era, grade_tier, bucket0, bucket1, count(*) n, sum(log_return) sum_y, sum(log_return * log_return) sum_y2
from index_pairs group by all""", sum_y=6, sum_y2=6)
def _(m):
    return index.pair_statistics(index.build_pairs(index.partitioned_sales(m.tx_clean, m.card_master)))


@query("a16_endpoint_counts", """
select era, grade_tier, period_start, count(*) n_pairs from (
 select era, grade_tier, bucket0 period_start from index_pairs union all select era, grade_tier, bucket1 from index_pairs) e group by all""")
def _(m):
    return index.endpoint_counts(index.build_pairs(index.partitioned_sales(m.tx_clean, m.card_master)))


@query("a17_outlier_moments", """
select era, grade_tier, count(*) n, avg(ln(price1 / price0)) mu, stddev_pop(ln(price1 / price0)) sigma from pairs_raw group by 1, 2""",
       mu=6, sigma=6)
def _(m):
    return index.outlier_moments(index.consecutive_pairs(index.partitioned_sales(m.tx_clean, m.card_master)))


@query("set02_observed_periods", """
select era, grade_tier, bucket0 period_start from index_pairs union select era, grade_tier, bucket1 from index_pairs""")
def _(m):
    return index.observed_periods(index.build_pairs(index.partitioned_sales(m.tx_clean, m.card_master)))


@query("set03_period_grid", """
select era, grade_tier, unnest(generate_series(least(min(bucket0), min(bucket1)), greatest(max(bucket0), max(bucket1)), interval 7 day)) period_start
from index_pairs group by era, grade_tier""")
def _(m):
    return index.period_axis(index.build_pairs(index.partitioned_sales(m.tx_clean, m.card_master)))


@query("a38_overlapping_partitions", """
with s as (select tx_id, e.era, t.tier grade_tier from (
  select tx_id, slab_grader g, slab_grade d, card_year y from tx_clean t join card_master c on c.card_id = t.card_id where cert_number is not null) b,
 (values ('modern'), ('vintage'), ('all')) e(era), (values ('PSA10'), ('PSA9'), ('PSA8'), ('lower'), ('all')) t(tier)
 where (e.era = 'all' or e.era = case when y >= 2010 then 'modern' else 'vintage' end)
  and (t.tier = 'all' or (t.tier = 'lower' and g is not null and d < 8) or (t.tier = 'PSA' || cast(d as int) and g = 'PSA' and d >= 8)))
select era, grade_tier, count(*) n from s group by all""")
def _(m):
    sales = index.partitioned_sales(m.tx_clean, m.card_master, ("PSA10", "PSA9", "PSA8", "lower", "all"), with_all_eras=True)
    return sales.groupBy("era", "grade_tier").agg(F.count(F.lit(1)).alias("n"))


@query("a39_repeat_certs", "select cert_number, count(*) n from tx_clean group by 1 having count(*) > 1")
def _(m):
    return m.tx_clean.groupBy("cert_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("d02_repeat_sales_index", index_value=6, se=6)
def _(m):
    return index.repeat_sales_index(m.tx_clean, m.card_master)


@query("d02_normal_equations", """
select era, grade_tier, period_start, count(*) n_pairs, 0.0::double gradient from (
 select era, grade_tier, bucket0 period_start from index_pairs union all select era, grade_tier, bucket1 from index_pairs) e group by all""", gradient=5)
def _(m):
    """Least squares leaves no gradient in any period that pairs touch."""
    parts = ["era", "grade_tier"]
    level = m.weekly_index.select(*parts, "period_start", F.log("index_value").alias("x"))
    stats = index.pair_statistics(index.build_pairs(index.partitioned_sales(m.tx_clean, m.card_master)))
    ends = [level.select(*parts, F.col("period_start").alias(f"bucket{i}"), F.col("x").alias(f"x{i}")) for i in (0, 1)]
    rest = stats.join(ends[0], [*parts, "bucket0"]).join(ends[1], [*parts, "bucket1"]).withColumn("r", F.col("sum_y") - F.col("n") * (F.col("x1") - F.col("x0")))
    sides = [rest.select(*parts, F.col(f"bucket{i}").alias("period_start"), "n", (s * F.col("r")).alias("r")) for i, s in ((0, -1.0), (1, 1.0))]
    return sides[0].union(sides[1]).groupBy(*parts, "period_start").agg(F.sum("n").alias("n_pairs"), F.sum("r").alias("gradient"))


@query("d02_repeat_sales_index_monthly", index_value=6, se=6)
def _(m):
    return index.repeat_sales_index(m.tx_clean, m.card_master, "monthly", ("PSA10", "PSA9", "PSA8", "lower", "all"), with_all_eras=True)


view("level_index", """
select period_start, 'NBA' sport, 'weekly' bucket, grade_tier, era,
 100 * exp(level - first_value(level) over (partition by era, grade_tier order by period_start)) index_value, n_pairs
from (select era, grade_tier, date_trunc('week', sold_at) period_start, avg(ln(price_usd)) as level, count(*) n_pairs
 from index_sales where grade_tier = 'PSA10' group by 1, 2, 3) w""")


@query("d52_price_level_index", "select * from level_index", index_value=6)
def _(m):
    return m.level_index


@query("d52_index_vs_benchmark", """
with b as (select date_trunc('week', o_orderdate) period_start, avg(o_totalprice) bench from orders group by 1),
j as (select era, period_start, ln(index_value) a, ln(bench) b from level_index join b using (period_start)),
d as (select *, a - lag(a) over (partition by era order by period_start) da, b - lag(b) over (partition by era order by period_start) db from j)
select era, count(*) periods, corr(a, b) level_corr, corr(da, db) return_corr from d group by era having count(*) >= 4""", level_corr=6, return_corr=6)
def _(m):
    bench = m.raw("orders").select(F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_totalprice").alias("value"))
    return index.index_vs_benchmark(m.level_index, bench, by=["era"])


@query("a37_benchmark_weekly", "select date_trunc('week', o_orderdate) period_start, avg(o_totalprice) bench from orders group by 1", bench=4)
def _(m):
    bench = m.raw("orders").select(F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_totalprice").alias("value"))
    return index.benchmark_weekly(bench)


@query("j25_aligned_periods", """
with b as (select date_trunc('week', o_orderdate) period_start, avg(o_totalprice) bench from orders group by 1)
select era, period_start, index_value, bench from level_index join b using (period_start)""", index_value=6, bench=4)
def _(m):
    bench = m.raw("orders").select(F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_totalprice").alias("value"))
    ours = m.level_index.select("era", "period_start", "index_value")
    return ours.join(index.benchmark_weekly(bench), "period_start")


# --- catalyst ------------------------------------------------------------------
CASES = " ".join(f"when '{k}' then {v}" for k, v in (("mvp", 0.5), ("all_star", 0.1), ("playoff_win", 0.01), ("signed", 0.0)))
view("event_mass", f"""
select *, case event_type {CASES} else case when cast(json_extract_string(event_payload, '$.k') as double) < 4 then -0.05 else -0.15 end end w,
 case when event_type in ('mvp', 'all_star') then 90 else 30 end h from player_events""")


def _score(at: str) -> str:
    return (f"coalesce(sum(w * pow(0.5, (epoch_us({at}) - epoch_us(event_date)) / 86400e6 / h)) "
            f"filter (event_date <= {at} and event_date >= {at} - interval 90 day), 0)")


view("catalyst_scores", f"""
select p.player_id, round({_score(EV_OF)}, 6) catalyst_score
from player_master p left join event_mass e on e.player_id = p.player_id group by p.player_id""")


@query("d06_catalyst_scores", "select * from catalyst_scores", catalyst_score=6)
def _(m):
    return catalyst.catalyst_scores(m.player_events, m.player_master, m.events_as_of, payload_weight=weeks_in_k)


@query("a14_decayed_event_sum", f"select player_id, {_score(EV_OF)} score from event_mass where w <> 0 group by player_id", score=6)
def _(m):
    known = catalyst.weighted_events(asof_slice_closed(m.player_events, "event_date", m.events_as_of, 90), weeks_in_k)
    return known.groupBy("player_id").agg(catalyst._decayed(m.events_as_of, 90).alias("score"))


@query("d07_catalyst_change", f"""
select player_id, a catalyst_score, round(a - b, 6) catalyst_change from (select p.player_id, round({_score(EV_OF)}, 6) a,
 round({_score(EV_OF + " - interval 15 day")}, 6) b
 from player_master p left join event_mass e on e.player_id = p.player_id group by p.player_id) s""", catalyst_score=6, catalyst_change=6)
def _(m):
    return catalyst.catalyst_change(m.player_events, m.player_master, m.events_as_of, days=15, payload_weight=weeks_in_k)


view("catalyst_grid", """
select p.player_id, g.as_of from player_master p,
 (select unnest(generate_series(timestamp '2023-08-03', timestamp '2024-01-30', interval 7 day)) as_of) g""")


@query("d08_catalyst_series", """
select g.player_id, g.as_of, round(coalesce(sum(w * pow(0.5, (epoch_us(g.as_of) - epoch_us(event_date)) / 86400e6 / h)), 0), 6) catalyst_score
from catalyst_grid g left join event_mass e on e.player_id = g.player_id and event_date <= g.as_of and event_date >= g.as_of - interval 90 day
group by 1, 2""", catalyst_score=6)
def _(m):
    return catalyst.catalyst_series(m.player_events, m.player_master, "2024-01-30", payload_weight=weeks_in_k)


@query("j11_player_day_events", """
with d as (select distinct player_id, date_trunc('day', event_date) as day from player_events)
select d.player_id, d.day, round(coalesce(sum(w * pow(0.5, (epoch_us(d.day) - epoch_us(event_date)) / 86400e6 / h)), 0), 6) catalyst_score
from d left join event_mass e on e.player_id = d.player_id and event_date <= d.day and event_date >= d.day - interval 90 day
group by 1, 2""", catalyst_score=6)
def _(m):
    grid = m.player_events.select("player_id", F.date_trunc("day", "event_date").alias("day")).distinct()
    return catalyst.catalyst_on_days(m.player_events, grid, payload_weight=weeks_in_k)


@query("f23_injury_weight", """
select event_id, case when event_type = 'injury_out' then w end weight from event_mass where event_type = 'injury_out'""", weight=4)
def _(m):
    hurt = m.player_events.where("event_type = 'injury_out'")
    return hurt.select("event_id", weeks_in_k(F.col("event_payload"), F.lit(-0.15)).alias("weight"))


@query("f24_json_key", "select event_id, coalesce(json_extract_string(event_payload, '$.k'), 'unknown') k from player_events")
def _(m):
    return m.player_events.select("event_id", F.coalesce(F.get_json_object("event_payload", "$.k"), F.lit("unknown")).alias("k"))


@query("f01_date_buckets", """
select tx_id, date_trunc('week', sold_at) monday, date_trunc('week', sold_at - interval 1 day) + interval 1 day tuesday,
 date_trunc('month', sold_at) as month from tx_clean""")
def _(m):
    at = F.col("sold_at")
    return m.tx_clean.select("tx_id", dates.week_monday(at).alias("monday"), dates.week_tuesday(at).alias("tuesday"), dates.month_start(at).alias("month"))


@query("f07_liquidity_tier_index", """
select card_id, liquidity_tier, cast(case liquidity_tier when 'A' then 0 when 'B' then 1 when 'C' then 2 when 'D' then 3 end as int) ix from liquidity_panel""")
def _(m):
    full = factors.liquidity_panel(m.tx_clean, m.card_master, m.as_of)
    return full.select("card_id", "liquidity_tier", cards.tier_index(F.col("liquidity_tier")).alias("ix"))
