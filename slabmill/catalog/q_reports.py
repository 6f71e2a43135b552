"""Report queries and the joins, aggregates and orderings they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from slabmill.catalog.q_factors import AS_OF, EV_OF
from slabmill.catalog.q_portfolio import _positions
from slabmill.catalog.q_pricing import TT, _ev, _signals, _targets, group_mean_residuals
from slabmill.catalog.q_scouting import FW, _premiums, _slug_players, forward
from slabmill.catalog.q_text import _done, _failed, _pick, listing_titles, reviewed
from slabmill.catalog.registry import query, view
from slabmill.functions import cards, dates, money, sale_text
from slabmill.operators.asof import asof_slice, asof_slice_closed
from slabmill.plans import catalyst, events, factors, holdings, reports

DAY = f"cast({AS_OF} as date)"


# --- index, mispricing, prospects -------------------------------------------------------
@query("r01_index_series", "select period_start as_of, era || '/' || grade_tier sleeve, index_value from level_index where index_value is not null", index_value=6)
def _(m):
    return reports.index_series(m.level_index)


view("residual_detail", """
select m.tx_id, residual, exp(predicted_log_price) fair_value, card_year, set_name, parallel, p.name player from mispricing m join tx_clean t on t.tx_id = m.tx_id
join card_master c on c.card_id = t.card_id join player_master p on p.player_id = c.player_id""")
RD = {"residual": 6, "fair_value": 3}


def _detail(m):
    return reports.residual_detail(group_mean_residuals(m), m.tx_clean, m.card_master, m.player_master)


@query("j02_three_hop_join", "select * from residual_detail", **RD)
def _(m):
    return _detail(m)


@query("r02_undervalued", "select * from residual_detail order by residual desc, tx_id limit 20", **RD)
def _(m):
    return reports.top_residuals(_detail(m))


@query("r02_overvalued", "select * from residual_detail order by residual, tx_id limit 20", **RD)
def _(m):
    return reports.top_residuals(_detail(m), by="overvalued")


@query("t01_top_n", "select tx_id, residual from residual_detail order by residual desc, tx_id limit 7", residual=6)
def _(m):
    return reports.top_residuals(_detail(m), 7).select("tx_id", "residual")


@query("t02_top_absolute", "select tx_id, residual from residual_detail order by abs(residual) desc, tx_id limit 15", residual=6)
def _(m):
    return reports.top_residuals(_detail(m), 15, "absolute").select("tx_id", "residual")


@query("r23_top_absolute_residuals", "select * from residual_detail order by abs(residual) desc, tx_id limit 20", **RD)
def _(m):
    return reports.top_residuals(_detail(m), by="absolute")


view("player_premiums", "select player_id, draft_year, premium, percentile_rank from premiums join slug_players using (br_slug)")


@query("r03_stardom_board", """
select s.player_id, 'P' || s.player_id as name, draft_year, premium, percentile_rank from player_premiums s where draft_year = 2014""", premium=7, percentile_rank=7)
def _(m):
    scores = _premiums(m).join(_slug_players(m), "br_slug").select("player_id", "draft_year", "premium", "percentile_rank")
    named = _slug_players(m).select("player_id", F.concat(F.lit("P"), "player_id").alias("name"))
    return reports.stardom_board(scores, named, 2014)


@query("r04_latest_forward_prospects", "select * from forward where draft_year = (select max(draft_year) from forward) order by premium desc nulls last, br_slug", **FW)
def _(m):
    older = m.stored("forward", lambda: forward(m))
    both = older.unionByName(older.withColumn("as_of_date", F.date_sub("as_of_date", 7)))
    return reports.latest_forward(both)


@query("t03_nulls_last", "select br_slug, premium from forward order by premium desc nulls last, br_slug limit 40", premium=7)
def _(m):
    return m.stored("forward", lambda: forward(m)).orderBy(F.col("premium").desc_nulls_last(), "br_slug").limit(40).select("br_slug", "premium")


@query("t07_top_prospects", "select br_slug, pairwise_score from forward order by pairwise_score desc, br_slug limit 15", pairwise_score=9)
def _(m):
    return m.stored("forward", lambda: forward(m)).orderBy(F.col("pairwise_score").desc(), "br_slug").limit(15).select("br_slug", "pairwise_score")


@query("r24_top_prospects_with_class", "select br_slug, name, premium, case years_until_draft when 2 then 'freshman' when 1 then 'sophomore' else 'upper' end class_label from forward order by pairwise_score desc, br_slug limit 25", premium=7)
def _(m):
    top = m.stored("forward", lambda: forward(m)).orderBy(F.col("pairwise_score").desc(), "br_slug").limit(25)
    label = F.when(F.col("years_until_draft") == 2, "freshman").when(F.col("years_until_draft") == 1, "sophomore").otherwise("upper")
    return top.select("br_slug", "name", "premium", label.alias("class_label"))


@query("r05_player_price_history", "select t.tx_id, t.sold_at, t.price_usd from tx_clean t join card_master c on c.card_id = t.card_id where c.player_id = 3", price_usd=8)
def _(m):
    return reports.player_price_history(m.tx_clean, m.card_master, 3)


# --- identity ---------------------------------------------------------------------------------
@query("r06_identity_summary", """
select count(*) candidates, count(distinct canonical_key) distinct_identities, count(*) filter (needs_review) needs_review,
 count(*) filter (not needs_review and coalesce(review_status, '') <> 'rejected') high_confidence, count(*) filter (review_status = 'rejected') rejected from reviewed""")
def _(m):
    return reports.identity_summary(m.stored("reviewed", lambda: reviewed(m)))


@query("a25_identity_summary_new", """
select count(*) candidates, count(distinct canonical_key) distinct_identities, count(*) filter (needs_review) needs_review,
 count(*) filter (not needs_review) high_confidence, cast(0 as bigint) rejected from card_identity_candidates""")
def _(m):
    from slabmill.catalog.q_text import candidates

    return reports.identity_summary(candidates(m))


@query("p09_review_filter", "select raw_id from reviewed where coalesce(review_status, '') <> 'rejected' and needs_review")
def _(m):
    return reports.review_filter(m.stored("reviewed", lambda: reviewed(m)), needs_review=True).select("raw_id")


@query("r07_review_queue", """
select r.raw_id, r.canonical_key, r.confidence, r.needs_review, r.search_query, l.raw_title, l.raw_price, l.sold_at from reviewed r join listing_titles l on l.raw_id = r.raw_id
where coalesce(review_status, '') <> 'rejected' order by r.needs_review desc, r.confidence, r.raw_id desc limit 200""", confidence=3, raw_price=8)
def _(m):
    out = reports.review_queue(m.stored("reviewed", lambda: reviewed(m)), listing_titles(m))
    return out.select("raw_id", "canonical_key", "confidence", "needs_review", "search_query", "raw_title", "raw_price", "sold_at")


KEYS = ", ".join(reports.ROLLUP_KEYS)
ROLL = f"""
select {KEYS}, count(*) n_rows, count(*) filter (needs_review) review_rows, min(confidence) min_confidence, max(confidence) max_confidence from card_identity_candidates group by {KEYS}"""


@query("a26_identity_rollup", ROLL, min_confidence=3, max_confidence=3)
def _(m):
    from slabmill.catalog.q_text import candidates

    return reports.identity_rollup(candidates(m), None)


@query("r08_identity_rollup", f"{ROLL} order by n_rows desc, canonical_key, slab_grader nulls first, slab_grade nulls first limit 200", min_confidence=3, max_confidence=3)
def _(m):
    from slabmill.catalog.q_text import candidates

    return reports.identity_rollup(candidates(m))


# --- NAV, panel, events -----------------------------------------------------------------------------
@query("r09_latest_nav", "select cast(o_orderdate as date) as date, 1000000 + sum(o_totalprice) / 100 nav from orders where o_custkey % 3 = 2 group by 1", nav=2)
def _(m):
    runs = m.raw("orders").groupBy((F.col("o_custkey") % 3).alias("run_id"), F.to_date("o_orderdate").alias("date")).agg((1000000 + F.sum("o_totalprice") / 100).alias("nav"))
    return reports.latest_run_nav(runs)


PANEL = {"r30": 6, "r90": 6, "r365": 6, "cs_momentum_pct": 6, "dollar_volume_90d": 2, "bid_ask_proxy": 6}


@query("r10_latest_factor_panel", """
select f.*, c.card_year, c.set_name, c.parallel, p.name player from factor_panel f join card_master c on c.card_id = f.card_id join player_master p on p.player_id = c.player_id""", **PANEL)
def _(m):
    return reports.latest_panel(m.factor_panel, m.card_master, m.player_master)


@query("j16_latest_snapshot_join", "select card_id, liquidity_tier from factor_panel")
def _(m):
    old = m.factor_panel.withColumn("as_of_date", F.date_sub("as_of_date", 7))
    return reports.at_latest(m.factor_panel.unionByName(old)).select("card_id", "liquidity_tier")


@query("r11_recent_events", f"""
select e.event_id, e.event_date, p.name player_name, e.event_type, e.event_payload from player_events e join player_master p on p.player_id = e.player_id
where e.event_date >= {EV_OF} - interval 30 day order by e.event_date desc, e.event_id desc limit 100""")
def _(m):
    return events.recent_events(m.player_events, m.player_master, m.events_as_of - F.expr("interval 30 days"))


@query("t04_mixed_order", "select event_id, event_type, event_date from player_events order by event_type, event_date desc, event_id limit 60")
def _(m):
    return m.player_events.orderBy("event_type", F.col("event_date").desc(), "event_id").limit(60).select("event_id", "event_type", "event_date")


@query("r12_top_catalysts", """
select s.player_id, name player_name, catalyst_score from catalyst_scores s join player_master p on p.player_id = s.player_id where s.player_id in (select player_id from player_events)
order by abs(catalyst_score) desc, s.player_id limit 10""", catalyst_score=6)
def _(m):
    from slabmill.catalog.market import weeks_in_k

    active = asof_slice_closed(m.player_events, "event_date", m.events_as_of, 30).select("player_id").distinct()
    scores = catalyst.catalyst_scores(m.player_events, active, m.events_as_of, payload_weight=weeks_in_k)
    return reports.top_catalysts(scores, m.player_master)


@query("r13_catalyst_sparkline", """
select g.as_of, round(coalesce(sum(w * pow(0.5, (epoch_us(g.as_of) - epoch_us(event_date)) / 86400e6 / h)), 0), 6) catalyst_score
from catalyst_grid g left join event_mass e on e.player_id = g.player_id and event_date <= g.as_of and event_date >= g.as_of - interval 90 day where g.player_id = 4 group by 1""", catalyst_score=6)
def _(m):
    from slabmill.catalog.market import weeks_in_k

    one = m.player_master.where("player_id = 4")
    return catalyst.catalyst_series(m.player_events.where("player_id = 4"), one, "2024-01-30", payload_weight=weeks_in_k).drop("player_id")


# --- health and capture ---------------------------------------------------------------------------------
view("health", """
select cast(r.ingested_at as date) as day, r.source, count(*) raw_count, count(d.raw_id) clean_count from tx_raw r left join done_rows d on d.raw_id = r.raw_id group by 1, 2""")


@query("a27_raw_vs_clean", "select * from health")
def _(m):
    return reports.raw_vs_clean(m.tx_raw, _done(m), None)


@query("r14_data_health", "select * from health order by day desc, source limit 30")
def _(m):
    return reports.raw_vs_clean(m.tx_raw, _done(m))


@query("j03_left_join_coverage", "select source, sum(raw_count)::bigint raw_count, sum(clean_count)::bigint clean_count from health group by 1")
def _(m):
    return reports.raw_vs_clean(m.tx_raw, _done(m), None).groupBy("source").agg(F.sum("raw_count").alias("raw_count"), F.sum("clean_count").alias("clean_count"))


@query("a28_warehouse_counters", """
select (select count(*) from tx_raw) raw_transactions, (select count(*) from done_rows) clean_transactions, (select count(*) from tx_raw where source = 'ebay') captured_rows,
 (select count(*) from failed_rows) parse_failures""")
def _(m):
    return reports.warehouse_counters(m.tx_raw, _done(m), _failed(m), captured="ebay")


view("coverage", "select json_extract_string(raw_json, '$.search_query') search_query, count(*) n_rows, max(ingested_at) latest_ingested_at from tx_raw where source = 'ebay' group by 1")


def _coverage(m):
    return reports.coverage(m.tx_raw, "ebay")


@query("a29_coverage", "select * from coverage")
def _(m):
    return _coverage(m)


@query("r15_capture_coverage", "select * from coverage order by n_rows desc, search_query")
def _(m):
    return _coverage(m).orderBy(F.col("n_rows").desc(), "search_query")


# The capture queue: brands of the catalogue and a few searches nobody has run yet.
view("queue", """
select ['A', 'B', 'C', 'D'][1 + k % 4] tier, brand || case when k % 5 = 0 then ' Select' else '' end search_query, cast(case when k % 3 = 0 then 100000 else 20 end as int) target_rows,
 case when k % 2 = 0 then 'daily' else 'weekly' end cadence from (select distinct p_brand brand, cast(split_part(p_brand, '#', 2) as int) k from part) b""")


def _queue(m):
    b = m.raw("part").select(F.col("p_brand").alias("brand")).distinct().withColumn("k", F.split_part("brand", F.lit("#"), F.lit(2)).cast("int"))
    k = F.col("k")
    return b.select(
        _pick(("A", "B", "C", "D"), k % 4).alias("tier"), F.concat(F.col("brand"), F.when(k % 5 == 0, " Select").otherwise("")).alias("search_query"),
        F.when(k % 3 == 0, 100000).otherwise(20).alias("target_rows"), F.when(k % 2 == 0, "daily").otherwise("weekly").alias("cadence"),
    )


view("targets_view", f"""
select *, case when needs_review_rows > 0 then 'review_identity' when remaining_rows > 0 then 'ingest_more' else 'covered' end next_action from (
 select q.tier, q.search_query, '{sale_text.SEARCH_URL}' || url_encode(q.search_query) url, coalesce(n_rows, 0) n_rows, target_rows, greatest(target_rows - coalesce(n_rows, 0), 0) remaining_rows,
  coalesce(n_rows, 0) / target_rows * 100 coverage_pct, coalesce(rv, 0) needs_review_rows, cadence, latest_ingested_at
 from queue q left join coverage c on c.search_query = q.search_query
 left join (select search_query, count(*) filter (needs_review) rv from reviewed where search_query <> 'Brand#7' group by 1) v on v.search_query = q.search_query) t""")


def _capture(m, limit):
    seen = m.stored("reviewed", lambda: reviewed(m)).where(F.get_json_object("evidence_json", "$.search_query") != "Brand#7")
    return reports.capture_targets(_queue(m), _coverage(m), seen, limit)


@query("r16_capture_targets", """
select * from targets_view order by case next_action when 'review_identity' then 0 when 'ingest_more' then 1 else 2 end, tier, coverage_pct, n_rows, search_query limit 12""", coverage_pct=6)
def _(m):
    return _capture(m, 12)


@query("f32_next_action", "select search_query, coverage_pct, remaining_rows, next_action from targets_view", coverage_pct=6)
def _(m):
    return _capture(m, None).select("search_query", "coverage_pct", "remaining_rows", "next_action")


@query("t05_custom_order", """
select search_query, tier, next_action from targets_view order by case next_action when 'review_identity' then 0 when 'ingest_more' then 1 else 2 end, tier, search_query limit 9""")
def _(m):
    out = _capture(m, None)
    order = [reports.custom_order(F.col("next_action"), reports.ACTION_ORDER), reports.custom_order(F.col("tier"), reports.TIER_ORDER)]
    return out.orderBy(*order, "search_query").limit(9).select("search_query", "tier", "next_action")


@query("r22_next_capture_plan", f"""
select q.tier, q.search_query, coalesce(n_rows, 0) current_rows, target_rows, target_rows - coalesce(n_rows, 0) remaining_rows, cadence, '{sale_text.SEARCH_URL}' || url_encode(q.search_query) url
from queue q left join coverage c on c.search_query = q.search_query where coalesce(n_rows, 0) < target_rows
order by q.tier, coalesce(n_rows, 0) / target_rows, q.search_query limit 10""")
def _(m):
    return reports.next_capture_plan(_queue(m), _coverage(m))


view("baskets", """
select q search_query, count(*) n_rows, median(p) median_price, avg(p) avg_price, max(p) high_sale, min(p) low_sale, stddev_samp(p) price_std, max(sold_at) latest_sale_at,
 max(ingested_at) latest_ingested_at, avg(case when p >= 2 * md and md > 0 then 1.0 else 0.0 end) premium_sale_pct
from (select json_extract_string(raw_json, '$.search_query') q, raw_price p, sold_at, ingested_at, median(raw_price) over (partition by json_extract_string(raw_json, '$.search_query')) md
 from tx_raw where source = 'ebay') b group by 1""")
BASKET = {"median_price": 6, "avg_price": 6, "high_sale": 8, "low_sale": 8, "premium_sale_pct": 7}


@query("a30_basket_stats", "select * from baskets", price_std=5, **BASKET)
def _(m):
    return reports.basket_stats(m.tx_raw, "ebay")


view("radar", """
select tier, search_query, target_rows, cadence, n_rows, median_price, avg_price, high_sale, low_sale, premium_sale_pct, latest_sale_at, latest_ingested_at, coverage_pct, price_volatility,
 round(40 * case when median_price > 0 then ln(1 + median_price) / ln(1 + (select max(median_price) from baskets)) else 0 end
  + 25 * case when n_rows > 0 then ln(1 + n_rows) / ln(1 + target_rows) else 0 end + 20 * premium_sale_pct + 15 * least(greatest(price_volatility, 0), 2) / 2 - 10 * coverage_pct / 100, 2) radar_score,
 case when n_rows >= target_rows then 'monitor' else 'ingest_more' end next_action from (
 select coalesce(tier, 'Z') tier, coalesce(q.search_query, b.search_query) search_query, coalesce(target_rows, 50) target_rows, coalesce(cadence, 'manual') cadence, coalesce(n_rows, 0) n_rows,
  coalesce(median_price, 0) median_price, coalesce(avg_price, 0) avg_price, coalesce(high_sale, 0) high_sale, coalesce(low_sale, 0) low_sale, coalesce(premium_sale_pct, 0) premium_sale_pct,
  latest_sale_at, latest_ingested_at, least(coalesce(n_rows, 0) / greatest(coalesce(target_rows, 50), 1) * 100, 100) coverage_pct, coalesce(price_std / nullif(median_price, 0), 0) price_volatility
 from queue q full join baskets b on b.search_query = q.search_query) x""")
RADAR = {**BASKET, "coverage_pct": 6, "price_volatility": 6, "radar_score": 2}


@query("r17_player_radar", "select * from radar", **RADAR)
def _(m):
    return reports.player_radar(_queue(m), reports.basket_stats(m.tx_raw, "ebay"))


@query("j17_full_outer_join", "select search_query, tier, n_rows from radar")
def _(m):
    return reports.player_radar(_queue(m), reports.basket_stats(m.tx_raw, "ebay")).select("search_query", "tier", "n_rows")


@query("f30_safe_log_ratio", "select tx_id, ln(1 + price_usd) / ln(1 + 30000) ratio from tx_clean", ratio=8)
def _(m):
    return m.tx_clean.select("tx_id", money.safe_log_ratio(F.col("price_usd"), F.lit(30000.0)).alias("ratio"))


# --- grading, letter, console -------------------------------------------------------------------------------
EVD = {"gem_rate": 4, "p10_price": 6, "p9_price": 6, "raw_price": 6, "ev": 2, "ev_per_dollar": 4, "cost_to_grade": 2}


@query("r18_grading_leaderboard", """
select g.*, c.card_year, c.set_name, c.parallel, p.name player from grading_ev g join card_master c on c.card_id = g.card_id left join player_master p on p.player_id = c.player_id
order by ev_per_dollar desc nulls last, g.card_id limit 50""", **EVD)
def _(m):
    return reports.grading_leaderboard(m.stored("grading_ev", lambda: _ev(m)), m.card_master, m.player_master)


@query("r19_index_returns", f"""
with s as (select era, period_start as_of, index_value from level_index), v as (
 select era, arg_max(index_value, as_of) filter (as_of <= timestamp '1999-12-31') a, arg_max(index_value, as_of) filter (as_of <= timestamp '1999-11-30') b,
 arg_max(index_value, as_of) filter (as_of <= timestamp '1999-09-30') c, arg_max(index_value, as_of) filter (as_of <= timestamp '1998-12-31') d from s group by era)
select era, coalesce(a / b - 1, 0) r1m, coalesce(a / c - 1, 0) r3m, coalesce(a / d - 1, 0) r12m from v""", r1m=6, r3m=6, r12m=6)
def _(m):
    series = m.level_index.select("era", F.col("period_start").alias("as_of"), "index_value")
    return reports.index_returns(series, "1999-12", by=["era"])


@query("r19_month_trades", "select cast(o_orderdate as date) trade_date, o_orderkey card_id from orders where o_orderdate >= timestamp '1997-03-01' and o_orderdate < timestamp '1997-04-01'")
def _(m):
    trades = m.raw("orders").select(F.to_date("o_orderdate").alias("trade_date"), F.col("o_orderkey").alias("card_id"))
    return reports.month_trades(trades, "1997-03")


FEE = "select coalesce(sum(fee_estimate), 0) / nullif(sum(price_usd), 0) fee_drag from tx_clean where year(sold_at) = 1999"


@query("a31_fee_drag", FEE, fee_drag=8)
def _(m):
    return reports.fee_drag(m.tx_clean, 1999)


@query("r19_top_mispricings", "select * from residual_detail order by residual desc, tx_id limit 5", **RD)
def _(m):
    return reports.top_residuals(_detail(m), 5)


@query("r19_sleeve_allocation", """
select sleeve, sum(w) target_weight, coalesce(sum(current_weight), 0) current_weight from positions p left join current_weights c on c.card_id = p.card_id group by 1""", target_weight=8, current_weight=8)
def _(m):
    from slabmill.plans.portfolio import cost_basis_weights

    return reports.sleeve_allocation(_positions(m), cost_basis_weights(m.portfolio_holdings))


@query("r20_trade_targets_for_ids", "select * from trade_targets where card_id % 7 = 0", **TT)
def _(m):
    ids = m.card_master.where("card_id % 7 = 0")
    return reports.targets_for(m.stored("trade_targets", lambda: _targets(m)), ids, m.as_of.cast("date"))


@query("j06_semi_join", "select tx_id from tx_clean where card_id in (select card_id from card_master where is_rookie)")
def _(m):
    return m.tx_clean.join(m.card_master.where("is_rookie").select("card_id"), "card_id", "left_semi").select("tx_id")


@query("r21_open_exit_signals", f"""
select holding_id || ':' || rule_triggered signal_id, recommended_action, {DAY} as_of_date from exit_signals where holding_id % 4 <> 0""")
def _(m):
    key = F.concat(F.col("holding_id").cast("string"), F.lit(":"), F.col("rule_triggered")).alias("signal_id")
    stamped = F.when(F.col("holding_id") % 4 == 0, dates.ts("1999-12-31")).alias("resolved_at")
    return reports.open_signals(_signals(m).select(key, "recommended_action", "as_of_date", stamped)).drop("resolved_at")


@query("p10_status_filter", "select holding_id, status from portfolio_holdings where status = 'held'")
def _(m):
    return reports.status_filter(m.portfolio_holdings, "held").select("holding_id", "status")


@query("p15_card_browse", "select card_id from card_master where set_name = 'PROMO' and card_year = 2005")
def _(m):
    return reports.card_browse(m.card_master, set_name="PROMO", year=2005).select("card_id")


@query("r25_parse_failures", """
select f.raw_id, f.reason, r.source, r.raw_title from (select * from failed_rows order by raw_id desc limit 200) f left join tx_raw r on r.raw_id = f.raw_id""")
def _(m):
    return reports.failures_with_titles(_failed(m), m.tx_raw)


# --- remaining joins and windows ------------------------------------------------------------------------------------
@query("j22_two_window_medians", "select card_id, jump from mom_hype where jump is not null", jump=6)
def _(m):
    stats = factors._price_stats(asof_slice(m.tx_clean, "sold_at", m.as_of, 400), m.as_of)
    both = stats.groupBy("card_id").agg(
        F.max(F.when(F.col("kind") == 1, F.col("median_price"))).alias("a"), F.max(F.when(F.col("kind") == 2, F.col("median_price"))).alias("b")
    )
    return both.where("a is not null and b is not null").select("card_id", (F.col("a") / F.col("b") - 1).alias("jump"))


@query("j23_universe_spine", "select card_id, sales_count_90d from liquidity_panel")
def _(m):
    active = factors.sales_activity(m.tx_clean, m.as_of).select("card_id", "sales_count_90d")
    return m.card_master.select("card_id").join(active, "card_id", "left").fillna(0, ["sales_count_90d"])


@query("w05_first_last_return", "select m.card_id, r90 from mom_returns m", r90=6)
def _(m):
    hist = asof_slice(m.tx_clean, "sold_at", m.as_of, 400)
    since = m.as_of - F.expr("interval 90 days")
    return factors._price_stats(hist, m.as_of).groupBy("card_id").agg(factors._simple_return(since).alias("r90"))


@query("w21_rescale_to_base", """
with b as (select era, grade_tier, min(period_start) filter (n_pairs >= 3) solid, min(period_start) fst from level_index group by 1, 2)
select l.era, l.period_start, 100 * l.index_value / k.index_value rescaled from level_index l join b on b.era = l.era and b.grade_tier = l.grade_tier
join level_index k on k.era = l.era and k.grade_tier = l.grade_tier and k.period_start = coalesce(b.solid, b.fst)""", rescaled=5)
def _(m):
    per = ["era", "grade_tier"]
    base = m.level_index.groupBy(*per).agg(
        F.coalesce(F.min_by("index_value", F.when(F.col("n_pairs") >= 3, F.col("period_start"))), F.min_by("index_value", "period_start")).alias("base")
    )
    return m.level_index.join(F.broadcast(base), per).select("era", "period_start", (100 * F.col("index_value") / F.col("base")).alias("rescaled"))


# --- holdings and overrides ---------------------------------------------------------------------------------------------
@query("d51_add_holdings", """
select o_orderkey holding_id, o.card_id, 'held' status, case when cs_momentum_pct is not null then cast(least(greatest(ceil(cs_momentum_pct * 10), 1), 10) as int) end entry_factor_decile,
 liquidity_tier entry_liquidity_tier from (select o_orderkey, o_orderkey % 200 card_id from orders) o left join factor_panel f on f.card_id = o.card_id""")
def _(m):
    fresh = m.raw("orders").select(F.col("o_orderkey").alias("holding_id"), (F.col("o_orderkey") % 200).alias("card_id"))
    return holdings.add_holdings(fresh, m.factor_panel).select("holding_id", "card_id", "status", "entry_factor_decile", "entry_liquidity_tier")


@query("d51_mark_sold", "select holding_id, case when holding_id % 6 = 0 then 'sold' else status end status, case when holding_id % 6 = 0 then 12.5 end sold_proceeds_usd from portfolio_holdings", sold_proceeds_usd=2)
def _(m):
    sales = m.portfolio_holdings.where("holding_id % 6 = 0").select("holding_id", m.as_of.alias("sold_at"), F.lit(12.5).alias("sold_proceeds_usd"))
    return holdings.mark_sold(m.portfolio_holdings, sales).select("holding_id", "status", "sold_proceeds_usd")


@query("d51_set_overrides", """
select card_id, case when card_id % 6 = 0 then 0.09 else (card_id % 5) / 100.0 end target_weight_pct from card_master where card_id % 3 = 0
union all select card_id, 0.09 from card_master where card_id % 6 <> 0 and card_id % 2 = 0 and card_id % 3 <> 0""", target_weight_pct=4)
def _(m):
    from slabmill.catalog.q_portfolio import _overrides

    changes = m.card_master.where("card_id % 2 = 0").select("card_id", F.lit(0.09).alias("target_weight_pct"), F.lit(1).alias("seq"))
    return holdings.set_overrides(_overrides(m), changes)


@query("d51_clear_overrides", "select card_id, (card_id % 5) / 100.0 target_weight_pct from card_master where card_id % 3 = 0 and card_id % 2 <> 0", target_weight_pct=4)
def _(m):
    from slabmill.catalog.q_portfolio import _overrides

    return holdings.clear_overrides(_overrides(m), m.card_master.where("card_id % 2 = 0"))


@query("f31_entry_decile", "select card_id, cast(least(greatest(ceil(cs_momentum_pct * 10), 1), 10) as int) decile from factor_panel where cs_momentum_pct is not null")
def _(m):
    scored = m.factor_panel.where("cs_momentum_pct is not null")
    return scored.select("card_id", cards.entry_decile(F.col("cs_momentum_pct")).alias("decile"))


