"""Anchor, allocation, risk and NAV queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slabmill.catalog.market import weeks_in_k
from slabmill.catalog.q_factors import AS_OF
from slabmill.catalog.q_pricing import LOW_GATE, _ev, _player_scores, mispricing_by_card
from slabmill.catalog.registry import query, view
from slabmill.config import Allocation
from slabmill.functions import cards, dates
from slabmill.plans import catalyst, grading
from slabmill.plans import portfolio as pf

DAY = f"cast({AS_OF} as date)"


# --- universe ---------------------------------------------------------------------
def _specs(m):
    """Anchor list of the test market: each player's first card, plus one that does not exist."""
    first = m.card_master.groupBy("player_id").agg(F.min("card_id").alias("card_id"))
    real = first.join(m.card_master.drop("player_id"), "card_id").join(m.player_master.select("player_id", "name"), "player_id")
    keys = ["card_year", "manufacturer", "set_name", "parallel", "name"]
    absent = real.select(F.lit(1899).alias("card_year"), *keys[1:]).where("player_id = 0")
    return real.select(*keys).unionByName(absent)


view("anchor_specs", """
select card_year, manufacturer, set_name, parallel, p.name from card_master c join player_master p on p.player_id = c.player_id
where card_id in (select min(card_id) from card_master group by player_id)
union all select 1899, manufacturer, set_name, parallel, p.name from card_master c join player_master p on p.player_id = c.player_id
where card_id in (select min(card_id) from card_master where player_id = 0 group by player_id)""")
view("resolved_anchors", """
select s.*, (select min(c.card_id) from card_master c join player_master p on p.player_id = c.player_id where c.card_year = s.card_year
 and c.manufacturer = s.manufacturer and c.set_name = s.set_name and c.parallel = s.parallel and p.name = s.name) card_id from anchor_specs s""")
view("anchors", f"""
select a.card_id, avg(price_usd) avg_price from (select distinct card_id from resolved_anchors where card_id is not null) a
left join tx_clean t on t.card_id = a.card_id and sold_at < {AS_OF} group by 1""")


@query("j14_anchor_resolution", "select *, card_id is not null resolved from resolved_anchors")
def _(m):
    return pf.resolve_anchors(_specs(m), m.card_master, m.player_master)


@query("d21_anchors", "select * from anchors", avg_price=6)
def _(m):
    return pf.anchors(_specs(m), m.card_master, m.player_master, m.tx_clean, m.as_of)


@query("a08_average_price", f"""
select c.card_id, avg(price_usd) avg_price from card_master c left join tx_clean t on t.card_id = c.card_id and sold_at < {AS_OF} group by 1""", avg_price=6)
def _(m):
    from slabmill.operators.asof import asof_slice

    avg = asof_slice(m.tx_clean, "sold_at", m.as_of).groupBy("card_id").agg(F.avg("price_usd").alias("avg_price"))
    return m.card_master.select("card_id").join(avg, "card_id", "left")


view("rookie_cards", """
select c.* replace (concat(set_name, [' Prizm', ' Topps Chrome', ' Prizm'][1 + card_id % 3]) as set_name, ['Silver', 'Base', 'Red'][1 + card_id % 7 % 3] as parallel)
from card_master c""")
view("score_rows", "select *, 1990 + player_id draft_year from player_scores")
view("flagship", f"""
select b.player_id, b.card_id, s.premium stardom_score, s.draft_year, s.fit_at computed_at from (
 select *, row_number() over (partition by player_id order by pr, card_id) r from (select *, case when lower(set_name) like '%prizm%' and lower(parallel) like '%silver%' then 0
  when lower(set_name) like '%prizm%' and lower(parallel) in ('base', '') then 1 when lower(set_name) like '%topps chrome%' then 2 end pr
  from rookie_cards where is_rookie) x where pr is not null) b
join (select *, row_number() over (partition by player_id order by fit_at desc) r from score_rows where fit_at <= {AS_OF}) s on s.player_id = b.player_id and s.r = 1
where b.r = 1 and s.draft_year >= 1995""")


def _rookie_cards(m):
    pick = lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), (1 + i).cast("int"))
    cid = F.col("card_id")
    return m.card_master.withColumn("set_name", F.concat(F.col("set_name"), pick((" Prizm", " Topps Chrome", " Prizm"), cid % 3))).withColumn(
        "parallel", pick(("Silver", "Base", "Red"), cid % 7 % 3)
    )


def _score_rows(m):
    return _player_scores(m).withColumn("draft_year", 1990 + F.col("player_id"))


def _flagship(m):
    return pf.flagship_rookie(_score_rows(m), _rookie_cards(m), m.as_of, 2000)


@query("d20_flagship_rookie", "select * from flagship", stardom_score=6)
def _(m):
    return _flagship(m)


@query("w17_priority_dedupe", """
select player_id, arg_min(card_id, (case when lower(set_name) like '%prizm%' and lower(parallel) like '%silver%' then 0
 when lower(set_name) like '%prizm%' and lower(parallel) in ('base', '') then 1 when lower(set_name) like '%topps chrome%' then 2 else 9 end, card_id)) card_id
from rookie_cards group by 1""")
def _(m):
    from slabmill.operators.asof import first_by

    rank = F.coalesce(cards.rookie_card_priority(F.col("set_name"), F.col("parallel")), F.lit(9))
    ranked = _rookie_cards(m).select("player_id", "card_id", rank.alias("rank"))
    return first_by(ranked, ["player_id"], ["rank", "card_id"]).drop("rank")


@query("p08_rookie_window", "select player_id, fit_at from score_rows where draft_year >= 1995")
def _(m):
    return pf.rookie_window(_score_rows(m), 2000).select("player_id", "fit_at")


@query("d53_stardom_for_cards", f"""
select card_id, premium stardom_premium from card_master c
join (select *, row_number() over (partition by player_id order by fit_at desc) r from score_rows where fit_at <= {AS_OF}) s on s.player_id = c.player_id and r = 1""",
       stardom_premium=6)
def _(m):
    return pf.stardom_for_cards(m.card_master, _score_rows(m), m.as_of)


@query("j21_player_value_on_cards", """
select card_id, coalesce(catalyst_score, 0.0) catalyst_score from card_master c left join catalyst_scores s on s.player_id = c.player_id""", catalyst_score=6)
def _(m):
    return pf.player_value_for_cards(m.card_master, _catalyst(m), "catalyst_score")


def _catalyst(m):
    return catalyst.catalyst_scores(m.player_events, m.player_master, m.events_as_of, payload_weight=weeks_in_k)


# --- allocation ----------------------------------------------------------------------
view("factor_universe", f"""
select {DAY} as_of_date, card_id, mispricing_residual, sport, parallel_tier, liquidity_tier, is_hyped, cs_momentum_pct
from mispricing_by_card join factor_panel using (card_id)""")
view("tradable_long", "select * from factor_universe where coalesce(liquidity_tier, '') <> 'D' and not coalesce(is_hyped, false) and mispricing_residual is not null")
view("long_names", """
select * exclude (r, c) from (select *, row_number() over (partition by as_of_date, sport, parallel_tier order by mispricing_residual desc, card_id) r,
 count(*) over (partition by as_of_date, sport, parallel_tier) c from tradable_long) x where r <= greatest(1, c // 4)""")
CFG = Allocation(decile_long=4, decile_short=5, prospect_top_n=3)


def _factor_universe(m):
    panel = m.factor_panel.select("card_id", "liquidity_tier", "is_hyped", "cs_momentum_pct")
    residuals = m.stored("mispricing_by_card", lambda: mispricing_by_card(m))
    return residuals.drop("computed_at").join(panel, "card_id").withColumn("as_of_date", m.as_of.cast("date"))


def _dated(m, df):
    return df.withColumn("as_of_date", m.as_of.cast("date"))


@query("p07_tradable", "select card_id from tradable_long")
def _(m):
    return pf.tradable(_factor_universe(m), True).where("mispricing_residual is not null").select("card_id")


@query("w15_top_fraction_per_group", "select card_id from long_names")
def _(m):
    return pf.select_decile(_factor_universe(m), 4).select("card_id")


def _waterfill(weight: str) -> str:
    return f"""
with s as (select card_id, greatest(coalesce(cs_momentum_pct, 0.5), 1e-9) s from long_names),
r as (select *, row_number() over (order by s desc, card_id) i, sum(s) over () tot,
 coalesce(sum(s) over (order by s desc, card_id rows between unbounded preceding and 1 preceding), 0) bef from s),
l as (select min_by(({weight} - (i - 1) * 0.01) / (tot - bef), i) rate from r where s * ({weight} - (i - 1) * 0.01) / (tot - bef) <= 0.01 + 1e-15)
select card_id, case when rate is null then 0.01 else least(0.01, rate * s) end w from r, l"""


view("factor_long", f"select * from ({_waterfill('0.1')}) x where w > 1e-12")
view("short_names", """
select card_id from (select *, row_number() over (partition by sport, parallel_tier order by mispricing_residual, card_id) r,
 count(*) over (partition by sport, parallel_tier) c from factor_universe where coalesce(liquidity_tier, '') <> 'D' and mispricing_residual is not null) x
where r <= greatest(1, c // 5)""")
view("positions", f"""
select {DAY} as_of_date, *, w * 1000000.0 target_usd_value, false is_override from (
 select card_id, 'anchor' sleeve, least(0.7 / count(*) over (), 0.1) w, 'anchor' signal_source from anchors union all
 select card_id, 'factor_long', w, 'factor' from factor_long union all
 select card_id, 'factor_short', -least(0.1 / count(*) over (), 0.01), 'factor' from short_names union all
 select card_id, 'prospect', least(0.1 / count(*) over (), 0.05), 'prospect' from (select * from flagship order by stardom_score desc, card_id limit 3) f) p""")


def _anchors(m):
    return _dated(m, pf.anchors(_specs(m), m.card_master, m.player_master, m.tx_clean, m.as_of))


def _positions(m):
    return m.stored("positions", lambda: pf.build_portfolio(_anchors(m), _factor_universe(m), _dated(m, _flagship(m)), CFG))


@query("d22_build_portfolio", "select * exclude (w), w target_weight_pct from positions", target_weight_pct=9, target_usd_value=3)
def _(m):
    return pf.build_portfolio(_anchors(m), _factor_universe(m), _dated(m, _flagship(m)), CFG)


@query("d22_anchor_only_fallback", f"""
select card_id, 'anchor' sleeve, least(1.0 / count(*) over (), 0.1) target_weight_pct from anchors""", target_weight_pct=9)
def _(m):
    return pf.build_portfolio(_anchors(m)).select("card_id", "sleeve", "target_weight_pct")


@query("d22_capped_proportional", _waterfill("0.2"), w=9)
def _(m):
    names = pf.select_decile(_factor_universe(m), 4)
    return pf.capped_proportional(names, "factor_long", 0.2, 0.01, "factor").select("card_id", F.col("target_weight_pct").alias("w"))


@query("u05_grading_overlay", "select card_id, cost target_usd_value, cost / 1000000 target_weight_pct from (" + """
with recursive c as (select card_id, raw_price, row_number() over (order by ev_per_dollar desc, card_id) i from grading_ev
 where raw_price is not null and ev_per_dollar is not null),
walk as (select cast(0 as bigint) i, cast(30000 as double) budget, cast(null as bigint) card_id, cast(null as double) cost union all
 select c.i, case when raw_price <= budget then budget - raw_price else budget end, case when raw_price <= budget then c.card_id end,
  case when raw_price <= budget then raw_price end from walk join c on c.i = walk.i + 1)
select card_id, cost from walk where card_id is not null) o""", target_usd_value=6, target_weight_pct=9)
def _(m):
    pool = m.stored("grading_ev", lambda: _ev(m)).where("raw_price is not null and ev_per_dollar is not null")
    out = pf.grading_overlay(pool, Allocation(overlay_weight=0.03))
    return out.select("card_id", "target_usd_value", "target_weight_pct")


@query("w19_budget_cut", "select card_id, cost from (" + """
with recursive c as (select card_id, raw_price, row_number() over (order by ev_per_dollar desc, card_id) i from grading_ev
 where sample_size >= 10 and raw_price is not null and ev_per_dollar >= 0.15),
walk as (select cast(0 as bigint) i, cast(10000 as double) budget, cast(null as bigint) card_id, cast(null as double) cost union all
 select c.i, case when raw_price <= budget then budget - raw_price else budget end, case when raw_price <= budget then c.card_id end,
  case when raw_price <= budget then raw_price end from walk join c on c.i = walk.i + 1)
select card_id, cost from walk where card_id is not null) o""", cost=6)
def _(m):
    pool = grading.ev_gate(m.stored("grading_ev", lambda: _ev(m)))
    return pf.grading_overlay(pool, Allocation(overlay_weight=0.01)).select("card_id", F.col("target_usd_value").alias("cost"))


@query("w19_budget_cut_of_small_samples", "select card_id, cost from (" + """
with recursive c as (select card_id, raw_price, row_number() over (order by ev_per_dollar desc, card_id) i from grading_ev
 where sample_size >= 2 and raw_price is not null and ev_per_dollar >= 0.15),
walk as (select cast(0 as bigint) i, cast(10000 as double) budget, cast(null as bigint) card_id, cast(null as double) cost union all
 select c.i, case when raw_price <= budget then budget - raw_price else budget end, case when raw_price <= budget then c.card_id end,
  case when raw_price <= budget then raw_price end from walk join c on c.i = walk.i + 1)
select card_id, cost from walk where card_id is not null) o""", cost=6)
def _(m):
    pool = grading.ev_gate(m.stored("grading_ev", lambda: _ev(m)), LOW_GATE)
    return pf.grading_overlay(pool, Allocation(overlay_weight=0.01)).select("card_id", F.col("target_usd_value").alias("cost"))


view("card_catalyst", "select card_id, coalesce(catalyst_score, 0.0) catalyst_score from card_master c left join catalyst_scores s on s.player_id = c.player_id")
view("tagged", """
select *, case when i <= n // 5 then 'top' when i > n - n // 5 then 'bottom' else 'middle' end tag from (
 select p.*, coalesce(catalyst_score, 0) sc, abs(w) aw, row_number() over (partition by sleeve order by coalesce(catalyst_score, 0) desc, p.card_id) i,
  count(*) over (partition by sleeve) n from positions p left join card_catalyst c on c.card_id = p.card_id) x""")
view("tilted", """
select card_id, sleeve, signal_source, case when sleeve = 'factor_short' then -1 else 1 end * nw target_weight_pct from (
 select *, least(case tag when 'top' then greatest(aw * 1.2 - case when abs(net) > 1e-12 and mid <= 1e-12 and net > 0 then net / nt else 0 end, 0)
  when 'bottom' then aw * 0.8 + case when abs(net) > 1e-12 and mid <= 1e-12 and net < 0 then -net / nb else 0 end
  else aw * case when abs(net) > 1e-12 and mid > 1e-12 then greatest(0, (mid - net) / mid) else 1 end end,
  case sleeve when 'anchor' then 0.10 when 'prospect' then 0.05 else 0.01 end) nw from (
 select *, 0.2 * (coalesce(sum(aw) filter (tag = 'top') over s, 0) - coalesce(sum(aw) filter (tag = 'bottom') over s, 0)) net,
  coalesce(sum(aw) filter (tag = 'middle') over s, 0) mid, count(*) filter (tag = 'top') over s nt, count(*) filter (tag = 'bottom') over s nb
 from tagged window s as (partition by sleeve)) a) b where nw > 1e-12""")


def _card_catalyst(m):
    return pf.player_value_for_cards(m.card_master, _catalyst(m), "catalyst_score")


@query("w16_quintile_tags", "select card_id, sleeve, tag from tagged")
def _(m):
    return pf.quintile_tags(_positions(m), _card_catalyst(m)).select("card_id", "sleeve", "tag")


@query("d23_tactical_tilt", "select * from tilted", target_weight_pct=9)
def _(m):
    return pf.tactical_tilt(_positions(m), _card_catalyst(m), CFG).drop("as_of_date")


view("overrides", "select card_id, (card_id % 5) / 100.0 target_weight_pct from card_master where card_id % 3 = 0")
view("overridden", """
select p.card_id, p.sleeve, coalesce(o.target_weight_pct, w) target_weight_pct,
 case when o.card_id is null then target_usd_value when w <> 0 then o.target_weight_pct * target_usd_value / w else 0 end target_usd_value,
 o.card_id is not null is_override from positions p left join overrides o on o.card_id = p.card_id""")


def _overrides(m):
    return m.card_master.where(F.col("card_id") % 3 == 0).select("card_id", ((F.col("card_id") % 5) / 100.0).alias("target_weight_pct"))


def _overridden(m):
    return pf.apply_overrides(_positions(m), _overrides(m))


@query("d24_apply_overrides", "select * from overridden", target_weight_pct=9, target_usd_value=3)
def _(m):
    return _overridden(m).select("card_id", "sleeve", "target_weight_pct", "target_usd_value", "is_override")


@query("j24_override_join", "select card_id, sleeve, is_override from overridden")
def _(m):
    return _overridden(m).select("card_id", "sleeve", "is_override")


@query("d25_cap_violations", """
select card_id, sleeve, target_weight_pct weight_pct, cap cap_pct from (select *, case sleeve when 'anchor' then 0.10 when 'prospect' then 0.05 else 0.01 end cap
 from overridden) o where abs(target_weight_pct) > cap + 1e-9""", weight_pct=9, cap_pct=4)
def _(m):
    return pf.cap_violations(_overridden(m))


@query("d26_herfindahl", "select sum(w * w) / pow(sum(abs(w)), 2) hhi, sum(w) filter (w > 0) long_weight from positions", hhi=9, long_weight=9)
def _(m):
    return pf.herfindahl(_positions(m))


@query("a32_concentration", """
select decade_label grp, pow(sum(abs(w)) / (select sum(abs(w)) from positions), 2) share_squared
from positions p left join card_features f on f.card_id = p.card_id group by 1""", share_squared=9)
def _(m):
    meta = m.card_master.select("card_id", cards.decade(F.col("card_year")).alias("era_group"))
    return pf.concentration(_positions(m), meta, F.col("era_group"))


view("nav", """
select cast(o_orderdate as date) as date, 1000000 + sum(o_totalprice) / 100 nav, sum(o_totalprice) / 10000 fees from orders group by 1""")
view("nav_curve", """
select *, nav / running_max - 1 drawdown from (select date, nav, max(nav) over (order by date) running_max,
 coalesce(nav / lag(nav) over (order by date) - 1, 0) ret from nav) x""")


def _nav(m):
    return m.raw("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (1000000 + F.sum("o_totalprice") / 100).alias("nav"), (F.sum("o_totalprice") / 10000).alias("fees"))


@query("w10_running_max_drawdown", "select date, running_max, drawdown from nav_curve", running_max=2, drawdown=8)
def _(m):
    return pf.nav_curve(_nav(m)).select("date", "running_max", "drawdown")


@query("w11_period_return", "select date, ret from nav_curve", ret=8)
def _(m):
    return pf.nav_curve(_nav(m)).select("date", "ret")


@query("d30_nav_metrics", """
select max_by(nav, date) final_nav, max_by(nav, date) / 1000000 - 1 total_return,
 case when stddev_pop(ret) > 0 then avg(ret) * 252 / (stddev_pop(ret) * sqrt(252)) else 0 end ir, min(drawdown) max_drawdown,
 (select sum(fees) from nav) / 1000000 fee_drag_pct, (select sum(fees) from nav) total_fees_usd, cast(7 as bigint) trade_count from nav_curve""",
       final_nav=2, total_return=7, ir=6, max_drawdown=7, fee_drag_pct=7, total_fees_usd=2)
def _(m):
    return pf.nav_metrics(_nav(m).select("date", "nav"), _nav(m).select("fees"), 1_000_000.0, 7)


@query("d33_monthly_nav", "select date_trunc('month', cast(date as timestamp)) month_start, max_by(nav, date) nav from nav group by 1", nav=2)
def _(m):
    return pf.monthly_nav(_nav(m))


@query("a33_beta", """
select coalesce(covar_pop(r, i) / nullif(var_pop(i), 0), 0) beta from (select a.ret r, b.ret i from nav_curve a join (
 select date, coalesce(v / lag(v) over (order by date) - 1, 0) ret from (select cast(o_orderdate as date) as date, avg(o_totalprice) v from orders group by 1) x) b
 on b.date = a.date) y""", beta=7)
def _(m):
    other = m.raw("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("nav"))
    own = pf.nav_curve(_nav(m)).select("date", F.col("ret").alias("r"))
    return pf.beta(own.join(pf.nav_curve(other).select("date", F.col("ret").alias("i")), "date"))


@query("a34_correlations", """
select corr(ln(nav), ln(fees)) level_corr, corr(dn, df) return_corr from (select *, ln(nav) - lag(ln(nav)) over (order by date) dn,
 ln(fees) - lag(ln(fees)) over (order by date) df from nav) x""", level_corr=7, return_corr=7)
def _(m):
    from pyspark.sql import Window

    order = Window.orderBy("date")
    x = _nav(m).select("date", F.log("nav").alias("a"), F.log("fees").alias("b"))
    x = x.withColumn("da", F.col("a") - F.lag("a").over(order)).withColumn("db", F.col("b") - F.lag("b").over(order))
    return x.agg(F.corr("a", "b").alias("level_corr"), F.corr("da", "db").alias("return_corr"))


view("current_weights", """
select card_id, sum(acquired_cost_usd) / (select sum(acquired_cost_usd) from portfolio_holdings where status = 'held') current_weight
from portfolio_holdings where status = 'held' group by 1""")


@query("a35_cost_basis_weights", "select * from current_weights", current_weight=9)
def _(m):
    return pf.cost_basis_weights(m.portfolio_holdings)


@query("d32_trade_list", """
select coalesce(p.card_id, c.card_id) card_id, coalesce(tw, 0) target_weight, coalesce(current_weight, 0) current_weight,
 coalesce(tw, 0) - coalesce(current_weight, 0) trade_weight from (select card_id, sum(w) tw from positions group by 1) p
full join current_weights c on c.card_id = p.card_id""", target_weight=9, current_weight=9, trade_weight=9)
def _(m):
    return pf.trade_list(_positions(m), m.portfolio_holdings)


@query("t08_positions_by_weight", "select card_id, sleeve, w target_weight_pct from positions order by abs(w) desc, card_id, sleeve limit 20", target_weight_pct=9)
def _(m):
    top = _positions(m).orderBy(F.abs("target_weight_pct").desc(), "card_id", "sleeve").limit(20)
    return top.select("card_id", "sleeve", "target_weight_pct")


# --- panels ---------------------------------------------------------------------------------
START, END = "1900-01-01", "2100-01-01"
view("price_panel", f"""
select cast(sold_at as date) as date, card_id, avg(price_usd) mean_price, count(*) volume from tx_clean
where sold_at >= timestamp '{START}' and sold_at < timestamp '{END}' group by 1, 2""")
view("locf", """
select g.date, g.card_id, p.mean_price price from (
 select card_id, cast(unnest(generate_series(min(date), (select max(date) from price_panel), interval 1 day)) as date) as date from price_panel group by card_id) g
asof left join price_panel p on p.card_id = g.card_id and g.date >= p.date""")
view("trailing_sales", """
select date, card_id, cast(coalesce(sum(volume) over (partition by card_id order by date range between interval 90 day preceding and interval 1 day preceding), 0) as bigint) trailing_volume
from price_panel""")


def _panel(m):
    return pf.price_panel(m.tx_clean, m.card_master, dates.ts(START), dates.ts(END))


@query("d27_price_panel", "select * from price_panel", mean_price=7)
def _(m):
    return _panel(m)


@query("a07_daily_mean_price", "select cast(sold_at as date) as date, card_id, avg(price_usd) mean_price, count(*) volume from tx_clean group by 1, 2", mean_price=7)
def _(m):
    return pf.price_panel(m.tx_clean, m.card_master, dates.ts("1900-01-01"), dates.ts("2100-01-01"))


@query("w08_locf_daily_spine", "select card_id, count(*) as n_days, min(date) first_day, max(date) last_day, sum(price) price_days, max(price) top_price from locf group by card_id", price_days=3, top_price=7)
def _(m):
    days = pf.locf_panel(_panel(m)).groupBy("card_id")
    return days.agg(
        F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.sum("price").alias("price_days"), F.max("price").alias("top_price"),
    )


@query("w09_trailing_volume", "select * from trailing_sales")
def _(m):
    return pf.trailing_volume(_panel(m)).select("date", "card_id", "trailing_volume")


@query("d28_liquidity_cap", "select date, card_id, 0.05 * trailing_volume max_units from trailing_sales", max_units=4)
def _(m):
    return pf.liquidity_cap(_panel(m))


@query("d29_target_units", """
select p.card_id, sleeve, w * 1000000 / price units from positions p join locf l on l.card_id = p.card_id
where l.date = (select max(date) from locf) and price > 0""", units=6)
def _(m):
    panel = _panel(m)
    last = panel.agg(F.max("date").alias("d")).scalar()
    return pf.target_units(_positions(m), pf.prices_on(panel, last), 1_000_000.0)


@query("d31_mark_to_market", """
select c.date, 1000.0 + coalesce(sum(l.card_id % 5 * price), 0) nav from (select distinct date from locf) c left join locf l on l.date = c.date group by 1""", nav=3)
def _(m):
    panel = _panel(m)
    units = panel.groupBy("card_id").agg(F.min("date").alias("date")).withColumn("units", F.col("card_id") % 5)
    span = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    cash = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"), F.lit(1000.0).alias("cash"))
    return pf.mark_to_market(units, pf.price_intervals(panel), cash)


@query("set06_universe_union", "select card_id from anchors union select card_id from factor_universe union select card_id from flagship")
def _(m):
    return _anchors(m).select("card_id").union(_factor_universe(m).select("card_id")).union(_flagship(m).select("card_id")).distinct()


REBALANCE = ("1998-07-01", "1999-01-01", "1999-07-01", "2000-01-01")
view("rebalance_dates", "select unnest([" + ", ".join(f"timestamp '{d}'" for d in REBALANCE) + "]) d")
view("rebalance_facts", """
select cast(d as date) as_of_date, x.card_id, arg_max(residual, (sold_at, tx_id, residual)) mispricing_residual, 'NBA' sport, f.parallel_tier
from rebalance_dates cross join (select m.tx_id, residual, card_id, sold_at from mispricing m join tx_clean t on t.tx_id = m.tx_id) x
join card_features f on f.card_id = x.card_id where sold_at < d group by all""")


@query("d55_rebalance_targets", """
with n as (select *, row_number() over (partition by as_of_date, parallel_tier order by mispricing_residual desc, card_id) r,
 count(*) over (partition by as_of_date, parallel_tier) c from rebalance_facts),
l as (select * from n where r <= greatest(1, c // 10)), k as (select as_of_date, count(*) nn from l group by 1)
select l.as_of_date, card_id, 'factor_long' sleeve, least(0.01, 0.2 / nn) target_weight_pct from l join k on k.as_of_date = l.as_of_date
union all select cast(d as date), card_id, 'anchor', least(0.8 / count(*) over (partition by d), 0.1) from anchors cross join rebalance_dates""", target_weight_pct=9)
def _(m):
    from slabmill.catalog.q_pricing import group_mean_residuals

    residuals = group_mean_residuals(m).select("tx_id", "residual").join(m.tx_clean.select("tx_id", "card_id", "sold_at"), "tx_id")
    known = pf.known_on_dates(residuals, "sold_at", ["card_id"], ["sold_at", "tx_id", "residual"], REBALANCE)
    tier = cards.parallel_tier(F.col("is_one_of_one"), F.col("print_run"), F.col("parallel"))
    factor = known.join(m.card_master, "card_id").select(
        "as_of_date", "card_id", F.col("residual").alias("mispricing_residual"), F.lit("NBA").alias("sport"), tier.alias("parallel_tier"),
        F.lit("A").alias("liquidity_tier"), F.lit(False).alias("is_hyped"), F.lit(0.5).alias("cs_momentum_pct"),
    )
    grid = F.explode(F.array(*[F.lit(d).cast("date") for d in REBALANCE])).alias("as_of_date")
    anchor = pf.anchors(_specs(m), m.card_master, m.player_master, m.tx_clean, m.as_of).select(grid, "card_id")
    out = pf.build_portfolio(anchor, m.stored("rebalance_factor", lambda: factor), None, Allocation())
    return out.select("as_of_date", "card_id", "sleeve", "target_weight_pct")

