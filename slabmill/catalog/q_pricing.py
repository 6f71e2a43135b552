"""Fees, spreads, fair value, targets, exits, grading and hedonic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slabmill.catalog.market import weeks_in_k
from slabmill.catalog.q_factors import AS_OF
from slabmill.catalog.registry import query, view
from slabmill.config import GRADING_FEES, GradingGate
from slabmill.functions import cards, dates, money
from slabmill.operators.asof import asof_slice_closed
from slabmill.plans import grading, hedonic, pricing

# --- fees and other column functions -------------------------------------------
view("fee_sales", """
select tx_id, price_usd, case length(tx_id) % 3 when 0 then 'ebay' when 1 then 'goldin' else 'private' end channel from tx_clean""")


def _fee_sales(m):
    n = F.length("tx_id") % 3
    return m.tx_clean.select("tx_id", "price_usd", F.when(n == 0, "ebay").when(n == 1, "goldin").otherwise("private").alias("channel"))


@query("f10_channel_costs", """
select tx_id, case channel when 'ebay' then price_usd * (1 - 0.1325) - 0.30 when 'goldin' then price_usd * (1 - 0.1) else price_usd end net,
 case channel when 'goldin' then price_usd * (1 + 0.2) else price_usd end landed,
 (price_usd - (price_usd * (1 - 0.1325) - 0.30)) / price_usd round_trip from fee_sales""", net=11, landed=9, round_trip=10)
def _(m):
    p, c, e = F.col("price_usd"), F.col("channel"), F.lit("ebay")
    return _fee_sales(m).select("tx_id", money.net_proceeds(p, c).alias("net"), money.landed_cost(p, c).alias("landed"),
                                money.round_trip_cost(p, p, e, e).alias("round_trip"))


@query("f11_grading_costs", """
select tx_id, case length(tx_id) % 2 when 0 then 24.99 else 149.99 end fee, greatest(99.99, price_usd * 0.05) regrade from tx_clean""",
       fee=2, regrade=9)
def _(m):
    tier = F.when(F.length("tx_id") % 2 == 0, "value_bulk").otherwise("express")
    assert GRADING_FEES["express"] == 149.99
    return m.tx_clean.select("tx_id", money.cost_to_grade(tier).alias("fee"), money.regrade_cost(F.col("price_usd")).alias("regrade"))


@query("f09_recency_blend", f"""
select tx_id, exp(-d / 30.0) confidence, exp(-d / 30.0) * price_usd + (1 - exp(-d / 30.0)) * 100 blended
from (select *, greatest(date_diff('day', sold_at, {AS_OF}), 0) d from tx_clean) t""",
       confidence=8, blended=6)
def _(m):
    c = money.recency_confidence(F.greatest(dates.whole_days(m.as_of, F.col("sold_at")), F.lit(0)))
    return m.tx_clean.select("tx_id", c.alias("confidence"), money.blend(F.col("price_usd"), F.lit(100.0), c).alias("blended"))


view("card_features", """
select card_id, case when is_one_of_one then 5 when print_run is null then case when lower(coalesce(parallel, 'Base')) = 'base' then 0 else 1 end
  when print_run <= 10 then 4 when print_run <= 25 then 3 when print_run <= 99 then 2 when print_run <= 499 then 1 else 0 end parallel_tier,
 'flagship' set_tier, 'standard' team_market, case when card_year >= 2010 then 1 else 0 end era_modern,
 coalesce(cast(floor(card_year / 10) * 10 as int) || 's', 'unknown') decade_label
from card_master""")


@query("f05_parallel_tier", "select card_id, parallel_tier from card_features")
def _(m):
    return m.card_master.select("card_id", cards.parallel_tier(F.col("is_one_of_one"), F.col("print_run"), F.col("parallel")).alias("parallel_tier"))


@query("f06_set_tier_market_era", """
select c.card_id, case when name like '%national treasures%' or name like '%flawless%' or name like '%immaculate%' then 'premium'
 when name like '%mosaic%' or name like '%optic%' then 'mid' when name like '%prizm%' or name like '%select%' or name like '%topps chrome%' then 'flagship'
 when name like '%hoops%' or name like '%donruss%' then 'low' else 'flagship' end set_tier,
 case when upper(team) in ('LAL', 'NYK', 'BOS', 'CHI', 'TOR') then 'premium' else 'standard' end team_market, era_modern
from (select c.*, lower(concat(set_name, ' ', ['Mosaic', 'Donruss', 'Flawless', 'Hoops', 'Select'][1 + card_id % 5])) as name, p.team
 from card_master c join player_master p on p.player_id = c.player_id) c join card_features f on f.card_id = c.card_id""")
def _(m):
    names = F.array(*[F.lit(x) for x in ("Mosaic", "Donruss", "Flawless", "Hoops", "Select")])
    name = F.concat_ws(" ", F.col("set_name"), F.element_at(names, (1 + F.col("card_id") % 5).cast("int")))
    joined = m.card_master.join(m.player_master.select("player_id", "team"), "player_id")
    return joined.select("card_id", cards.set_tier(name).alias("set_tier"), cards.team_market(F.col("team")).alias("team_market"),
                         cards.era_modern(F.col("card_year")).alias("era_modern"))


@query("f37_decade", "select card_id, decade_label from card_features")
def _(m):
    return m.card_master.select("card_id", cards.decade(F.col("card_year")).alias("decade_label"))


@query("f08_log_features", """
select s.card_id, ln(1 + pop_count) log_pop, ln(1 + coalesce(print_run, pop_count)) print_run_log from pop_snapshots s
join card_master c on c.card_id = s.card_id""", log_pop=8, print_run_log=8)
def _(m):
    j = m.pop_snapshots.join(m.card_master.select("card_id", "print_run"), "card_id")
    return j.select("card_id", F.log1p("pop_count").alias("log_pop"),
                    F.log1p(F.coalesce(F.col("print_run").cast("bigint"), F.col("pop_count"))).alias("print_run_log"))


@query("f02_ages", """
select tx_id, date_diff('day', dob::timestamp, sold_at) / 365.25 age, year(sold_at) - draft_year years_pro
from tx_clean t join card_master c on c.card_id = t.card_id join player_master p on p.player_id = c.player_id""", age=8)
def _(m):
    j = hedonic.star(m.tx_clean, m.card_master, m.player_master)
    return j.select("tx_id", dates.age_years(F.col("sold_at"), F.col("dob")).alias("age"),
                    dates.years_since(F.col("sold_at"), F.col("draft_year")).cast("bigint").alias("years_pro"))


@query("f12_price_targets", """
with t as (select card_id, price_usd f, case liquidity_tier when 'A' then .03 when 'B' then .05 when 'C' then .10 else .20 end m
 from tx_clean join liquidity_panel using (card_id))
select card_id, f * (1 - 0.04 - m) bid, f * (1 + 0.04 + 0.5 * 0.15) sell, least(f * (1 - 2 * m), f * (1 - 0.04 - m) - m * f) stop from t""",
       bid=9, sell=10, stop=9)
def _(m):
    j = m.tx_clean.select("card_id", "price_usd").join(m.factor_panel.select("card_id", "liquidity_tier"), "card_id")
    bid, sell, stop = money.price_targets(F.col("price_usd"), F.lit(0.04), F.col("liquidity_tier"), F.lit(0.5))
    return j.select("card_id", bid.alias("bid"), sell.alias("sell"), stop.alias("stop"))


# --- spreads -------------------------------------------------------------------------
view("trading_days", f"""
select card_id, date_trunc('day', sold_at) as day, max(price_usd) high, min(price_usd) low, count(*) n
from (select *, max(sold_at) over (partition by card_id) - interval 60 day cutoff from tx_clean where sold_at <= {AS_OF}) t
where sold_at >= cutoff group by 1, 2""")
K = "(3 - 2 * sqrt(2))"
view("day_pairs", """
select *, lead(high) over w nh, lead(low) over w nl from trading_days window w as (partition by card_id order by day)""")
view("day_spreads", f"""
select card_id, day, high, low, n, nh next_high, nl next_low,
 case when nh is not null then 2 * (exp(a) - 1) / (1 + exp(a)) end spread from (
 select *, greatest((sqrt(2 * b) - sqrt(b)) / {K} - sqrt(g / {K}), 0) a from (
 select *, pow(ln(case when low > 0 then high / low else 1 end), 2) + pow(ln(case when nl > 0 then nh / nl else 1 end), 2) b,
  pow(ln(case when least(low, nl) > 0 then greatest(high, nh) / least(low, nl) else 1 end), 2) g from day_pairs) x) y""")
view("half_spreads", """
select p.card_id, coalesce(case when trades >= 6 then s / 2 end,
 case p.liquidity_tier when 'A' then .03 when 'B' then .05 when 'C' then .10 else .20 end) half_spread
from liquidity_panel p left join (select card_id, sum(n) trades, median(spread) s from day_spreads group by 1) e on e.card_id = p.card_id""")


@query("a09_daily_high_low", "select * from trading_days", high=8, low=8)
def _(m):
    return pricing.trading_days(m.tx_clean, m.as_of)


@query("w07_two_day_spreads", "select card_id, day, spread from day_spreads where spread is not null", spread=7)
def _(m):
    out = pricing.day_spreads(pricing.trading_days(m.tx_clean, m.as_of))
    return out.select("card_id", "day", "spread").where("spread is not null")


@query("f13_spread_estimator", "select card_id, avg(spread) mean_spread, max(spread) max_spread from day_spreads group by 1", mean_spread=7, max_spread=7)
def _(m):
    out = pricing.day_spreads(pricing.trading_days(m.tx_clean, m.as_of))
    return out.groupBy("card_id").agg(F.avg("spread").alias("mean_spread"), F.max("spread").alias("max_spread"))


@query("d15_half_spread", "select * from half_spreads", half_spread=7)
def _(m):
    return pricing.half_spread(m.tx_clean, m.factor_panel.select("card_id", "liquidity_tier"), m.as_of)


@query("a10_median_half_spread", """
select card_id, median(spread) / 2 half_spread from day_spreads group by 1 having sum(n) >= 6 and count(spread) > 0""", half_spread=7)
def _(m):
    tiers = m.card_master.select("card_id", F.lit("A").alias("liquidity_tier"))
    est = pricing.day_spreads(pricing.trading_days(m.tx_clean, m.as_of)).groupBy("card_id")
    est = est.agg(F.sum("n").alias("n"), F.count("spread").alias("k"), (F.median("spread") / 2).alias("half_spread"))
    return est.where("n >= 6 and k > 0").select("card_id", "half_spread").join(tiers.select("card_id"), "card_id", "left_semi")


# --- fair value, targets ------------------------------------------------------------------
view("last_and_cap", f"""
select card_id, max(sold_at) last_sold_at, least(arg_max(price_usd, (sold_at, tx_id, price_usd)), quantile_cont(price_usd, 0.95)) last_price
from tx_clean where sold_at <= {AS_OF} and sold_at >= {AS_OF} - interval 90 day group by 1""")
view("known_index", f"select era, period_start, index_value from level_index where period_start <= {AS_OF} and index_value is not null")
view("index_probe", f"""
select l.*, c.era, n.now_value, n.latest, coalesce(k.index_value, n.first_value) then_value
from last_and_cap l join (select card_id, case when card_year >= 2010 then 'modern' else 'vintage' end era from card_master) c on c.card_id = l.card_id
left join (select era, max_by(index_value, period_start) now_value, min_by(index_value, period_start) first_value, max(period_start) latest
 from known_index group by 1) n on n.era = c.era
asof left join known_index k on k.era = c.era and l.last_sold_at >= k.period_start""")
view("model_prices", "select card_id, avg(price_usd) predicted_price from tx_clean where slab_grader = 'PSA' and slab_grade >= 9 group by 1")
view("fair_value", f"""
select c.card_id, case when ip is null then m.predicted_price when m.predicted_price is null then ip
  else cf * ip + (1 - cf) * m.predicted_price end fair_value, coalesce(cf, 0) confidence, ip index_projected, m.predicted_price model_price,
  cast(d as int) days_since_last_sold
from card_master c left join (
 select *, case when ip is not null then exp(-d / 30.0) else 0 end cf from (
 select *, date_diff('day', last_sold_at, {AS_OF}) d, case when now_value is not null and then_value > 0
  and date_diff('day', latest, {AS_OF}) <= 14 then last_price * now_value / then_value end ip from index_probe) a) b on b.card_id = c.card_id
left join model_prices m on m.card_id = c.card_id""")
FV = {"fair_value": 5, "confidence": 7, "index_projected": 5, "model_price": 5}


def _model_prices(m):
    graded = m.tx_clean.where("slab_grader = 'PSA' and slab_grade >= 9")
    return graded.groupBy("card_id").agg(F.avg("price_usd").alias("predicted_price"))


def _fair(m):
    return pricing.fair_value(m.tx_clean, m.card_master, m.level_index, m.as_of, _model_prices(m))


def _targets(m):
    return pricing.trade_targets(m.factor_panel, m.tx_clean, m.card_master, m.level_index, m.as_of, _model_prices(m))


@query("w18_winsorized_last", "select * from last_and_cap", last_price=6)
def _(m):
    return pricing.last_and_cap(m.tx_clean, m.as_of)


@query("j10_index_probe", "select card_id, era, last_sold_at, last_price, now_value, latest, then_value from index_probe",
       last_price=6, now_value=6, then_value=6)
def _(m):
    return pricing.index_probe(pricing.last_and_cap(m.tx_clean, m.as_of), m.card_master, m.level_index, m.as_of)


@query("d16_fair_value", "select * from fair_value", **FV)
def _(m):
    return _fair(m)


view("zscores", """
select card_id, coalesce((cs_momentum_pct - avg(cs_momentum_pct) over ()) / nullif(stddev_pop(cs_momentum_pct) over (), 0), 0) zscore from factor_panel""")


@query("w03_zscore", "select * from zscores", zscore=6)
def _(m):
    return pricing.zscores(m.factor_panel)


view("trade_targets", f"""
select f.card_id, cast({AS_OF} as date) as_of_date, fair_value, fair_value * (1 - hs - mg) bid_max, fair_value * (1 + hs + z * 0.15) sell_target,
 least(fair_value * (1 - 2 * mg), fair_value * (1 - hs - mg) - mg * fair_value) stop_loss, confidence, hs half_spread_pct, mg liquidity_margin_pct
from (select p.card_id, v.fair_value, v.confidence, h.half_spread hs, s.zscore z,
 case p.liquidity_tier when 'A' then .03 when 'B' then .05 when 'C' then .10 else .20 end mg
 from factor_panel p join fair_value v on v.card_id = p.card_id join half_spreads h on h.card_id = p.card_id
 join zscores s on s.card_id = p.card_id where v.fair_value is not null) f""")
TT = {"fair_value": 5, "bid_max": 5, "sell_target": 5, "stop_loss": 5, "confidence": 7, "half_spread_pct": 7, "liquidity_margin_pct": 4}


@query("d17_trade_targets", "select * from trade_targets", **TT)
def _(m):
    return _targets(m)


@query("d17_trade_targets_repeat_sales", **TT)
def _(m):
    return pricing.trade_targets(m.factor_panel, m.tx_clean, m.card_master, m.weekly_index, m.as_of)


view("exit_probe", f"""
select h.holding_id, h.card_id, h.acquired_at, h.acquired_cost_usd, h.entry_factor_decile, h.entry_liquidity_tier, lp.price, t.sell_target, t.stop_loss,
 p.liquidity_tier tier_now, p.rank_pct
from portfolio_holdings h
left join (select card_id, arg_max(price_usd, (sold_at, tx_id, price_usd)) price from tx_clean where sold_at < {AS_OF} + interval 1 day group by 1) lp
 on lp.card_id = h.card_id
left join trade_targets t on t.card_id = h.card_id
left join (select card_id, liquidity_tier, case when cs_momentum_pct is not null then (rank() over (partition by cs_momentum_pct is null order by cs_momentum_pct)
  + (count(*) over (partition by cs_momentum_pct) - 1) / 2.0) / count(cs_momentum_pct) over () end rank_pct from factor_panel) p on p.card_id = h.card_id
where h.status = 'held'""")
PROBE = "holding_id, card_id, price, sell_target, stop_loss, tier_now, rank_pct"


@query("j26_exit_probe", f"select {PROBE} from exit_probe", price=6, sell_target=5, stop_loss=5, rank_pct=7)
def _(m):
    return pricing.exit_probe(m.portfolio_holdings, m.tx_clean, _targets(m), m.factor_panel, m.as_of).select(*PROBE.split(", "))


view("exit_signals", f"""
with p as (select *, date_diff('day', acquired_at, {AS_OF}) held, strpos('ABCD', tier_now) - strpos('ABCD', entry_liquidity_tier) dropped from exit_probe)
select holding_id, 'target_hit' rule_triggered, 'sell_50pct' recommended_action from p where price >= sell_target union all
select holding_id, 'factor_reversal', 'sell_100pct' from p where entry_factor_decile = 10 and rank_pct < 0.9 union all
select holding_id, 'time_stop', 'sell_100pct' from p where held > 540 and price < 1.10 * acquired_cost_usd union all
select holding_id, 'price_stop', 'sell_100pct' from p where price < stop_loss union all
select holding_id, 'liquidity_degrade', 'sell_100pct' from p where dropped >= 2""")


def _signals(m):
    targets = m.stored("trade_targets", lambda: _targets(m))
    return pricing.exit_signals(m.portfolio_holdings, m.tx_clean, targets, m.factor_panel, m.as_of)


@query("d18_exit_signals", f"select *, cast({AS_OF} as date) as_of_date from exit_signals")
def _(m):
    return _signals(m).drop("notes")


@query("d18_exit_signal_notes", f"""
with p as (select *, date_diff('day', acquired_at, {AS_OF}) held, strpos('ABCD', tier_now) - strpos('ABCD', entry_liquidity_tier) dropped from exit_probe)
select holding_id, 'target_hit' rule_triggered, 'last_sold=' || cast(cast(cast(price as varchar) as decimal(18, 2)) as varchar) || ' >= sell_target=' || cast(cast(cast(sell_target as varchar) as decimal(18, 2)) as varchar) notes from p where price >= sell_target union all
select holding_id, 'factor_reversal', 'factor_rank_pct=' || cast(cast(cast(rank_pct as varchar) as decimal(18, 2)) as varchar) || ' (dropped from top decile)' from p where entry_factor_decile = 10 and rank_pct < 0.9 union all
select holding_id, 'time_stop', 'held ' || held || 'd, price ' || cast(cast(cast(price as varchar) as decimal(18, 2)) as varchar) || ' < 1.1×cost' from p where held > 540 and price < 1.10 * acquired_cost_usd union all
select holding_id, 'price_stop', 'last_sold=' || cast(cast(cast(price as varchar) as decimal(18, 2)) as varchar) || ' < stop_loss=' || cast(cast(cast(stop_loss as varchar) as decimal(18, 2)) as varchar) from p where price < stop_loss union all
select holding_id, 'liquidity_degrade', 'tier ' || entry_liquidity_tier || ' → ' || tier_now from p where dropped >= 2""")
def _(m):
    return _signals(m).select("holding_id", "rule_triggered", "notes")


@query("d19_resolve_signals", f"""
select holding_id || ':' || rule_triggered signal_id, case when holding_id % 4 = 0 then timestamp '1999-12-31' when holding_id % 4 = 1 then {AS_OF} end resolved_at,
 holding_id % 4 = 1 changed from exit_signals""")
def _(m):
    hid = F.col("holding_id")
    signals = m.stored("exit_signals", lambda: _signals(m))  # read twice below
    stored = signals.select(
        F.concat(hid.cast("string"), F.lit(":"), F.col("rule_triggered")).alias("signal_id"), hid.alias("_h"),
        F.when(hid % 4 == 0, dates.ts("1999-12-31")).alias("resolved_at"),
    )
    asked = stored.where(F.col("_h") % 4 <= 1).select("signal_id")
    return pricing.resolve_signals(stored.drop("_h"), asked, m.as_of)


# --- grading ------------------------------------------------------------------------------
def _even(x: str, n: int) -> str:
    """Half-even rounding of a double by its decimal digits."""
    y = f"(cast(cast({x} as varchar) as decimal(30, 12)) * {10**n})"
    up = f"{y} - floor({y}) > 0.5 or ({y} - floor({y}) = 0.5 and floor({y}) % 2 = 1)"
    return f"((floor({y}) + case when {up} then 1 else 0 end) / {10.0**n}::double)"


view("latest_pop", f"""
select card_id, coalesce(sum(pop_count) filter (grade = 10), 0) p10, coalesce(sum(pop_count) filter (grade = 9), 0) p9,
 coalesce(sum(pop_count) filter (grade = 8), 0) p8
from (select *, max(snapshot_date) over (partition by card_id) mx from pop_snapshots where grader = 'PSA' and snapshot_date <= {AS_OF}) s
where snapshot_date = mx group by 1""")
view("gem_rates", f"""
select card_id, case when p10 + p9 + p8 > 0 then {_even('(10 + p10) / (20 + p10 + p9 + p8)', 4)} else 0.5 end gem_rate,
 cast(p10 + p9 + p8 as bigint) sample_size, case when p10 + p9 + p8 > 0 then p10 / (p10 + p9 + p8) end raw_rate, cast(p10 as bigint) p10_pop from latest_pop""")
view("growth_shares", f"""
select card_id, {', '.join(f'''case when sum(pop_count) filter (grade in (8, 9, 10) and snapshot_date = l{d}) - coalesce(sum(pop_count) filter (grade in (8, 9, 10) and snapshot_date = f{d}), 0) > 0
 then (coalesce(sum(pop_count) filter (grade = 10 and snapshot_date = l{d}), 0) - coalesce(sum(pop_count) filter (grade = 10 and snapshot_date = f{d}), 0))
 / (sum(pop_count) filter (grade in (8, 9, 10) and snapshot_date = l{d}) - coalesce(sum(pop_count) filter (grade in (8, 9, 10) and snapshot_date = f{d}), 0)) end share_{d}'''
 for d in (90, 365))}
from (select *, {', '.join(f"min(snapshot_date) filter (snapshot_date >= {AS_OF} - interval {d} day) over (partition by card_id) f{d}, max(snapshot_date) filter (snapshot_date >= {AS_OF} - interval {d} day) over (partition by card_id) l{d}" for d in (90, 365))}
 from pop_snapshots where grader = 'PSA' and snapshot_date <= {AS_OF} and snapshot_date >= {AS_OF} - interval 365 day) s group by 1""")
view("raw_prices", f"""
select card_id, median(price_usd) raw_price from tx_clean where slab_grader is null and sold_at <= {AS_OF} and sold_at >= {AS_OF} - interval 30 day group by 1""")
view("graded_prices", f"""
select card_id, median(price_usd) filter (slab_grade = 10) p10_price, median(price_usd) filter (slab_grade = 9) p9_price from tx_clean
where slab_grader = 'PSA' and sold_at < {AS_OF} group by 1 having p10_price is not null and p9_price is not null""")


def _ev_sql(trend: bool) -> str:
    factor = f"case when share_365 <> 0 and share_365 - share_90 >= 0.05 then {_even('share_90 / share_365', 4)} else 1.0 end" if trend else "1.0"
    exact = ("cast(gem as decimal(6, 4)) * cast(n10 as decimal(14, 2)) + (1 - cast(gem as decimal(6, 4))) * cast(n9 as decimal(14, 2)) - 24.99"
             " - coalesce(cast(raw_price as decimal(24, 12)), 0)")
    return f"""
select *, case when raw_price > 0 then {_even('ev / raw_price', 4)} end ev_per_dollar from (
 select card_id, cast({AS_OF} as date) as_of_date, 'value_bulk' grade_tier, gem gem_rate, p10_price, p9_price, 24.99::double cost_to_grade, raw_price,
  {_even(exact, 2)} ev, p10_pop, sample_size from (
  select p.card_id, p10_price, p9_price, raw_price, coalesce(p10_pop, 0) p10_pop, coalesce(sample_size, 0) sample_size,
   {_even('p10_price * 0.8675 - 0.30', 2)} n10, {_even('p9_price * 0.8675 - 0.30', 2)} n9, {_even(f'coalesce(gem_rate, 0.5) * {factor}', 4)} gem
  from graded_prices p left join gem_rates g on g.card_id = p.card_id left join raw_prices r on r.card_id = p.card_id
  left join growth_shares s on s.card_id = p.card_id) a) b"""


view("grading_ev", _ev_sql(False))
EV = {"gem_rate": 4, "p10_price": 6, "p9_price": 6, "raw_price": 6, "ev": 2, "ev_per_dollar": 4, "cost_to_grade": 2}


def _ev(m, trend=False):
    return grading.grading_ev(grading.graded_prices(m.tx_clean, m.as_of), m.pop_snapshots, m.tx_clean, m.as_of, trend=trend)


@query("a12_gem_rates", "select * from gem_rates", gem_rate=4, raw_rate=6)
def _(m):
    return grading.gem_rates(m.pop_snapshots, m.as_of)


@query("a13_growth_shares", "select * from growth_shares", share_90=6, share_365=6)
def _(m):
    return grading.growth_shares(m.pop_snapshots, m.as_of)


@query("w20_window_snapshots", f"""
select card_id, min(snapshot_date) first_at, max(snapshot_date) last_at from pop_snapshots
where grader = 'PSA' and snapshot_date <= {AS_OF} and snapshot_date >= {AS_OF} - interval 365 day group by 1""")
def _(m):
    known = asof_slice_closed(m.pop_snapshots, "snapshot_date", m.as_of, 365).where("grader = 'PSA'")
    return known.groupBy("card_id").agg(F.min("snapshot_date").alias("first_at"), F.max("snapshot_date").alias("last_at"))


@query("a11_raw_clearing_price", "select * from raw_prices", raw_price=8)
def _(m):
    return grading.raw_clearing_price(m.tx_clean, m.as_of)


@query("d13_grading_ev", "select * from grading_ev", **EV)
def _(m):
    return _ev(m)


@query("d13_grading_ev_trend", _ev_sql(True), **EV)
def _(m):
    return _ev(m, trend=True)


@query("f35_gem_trend", f"""
select card_id, case when share_365 <> 0 and share_365 - share_90 >= 0.05 then {_even('share_90 / share_365', 4)} else 1.0 end factor from growth_shares""", factor=4)
def _(m):
    shares = grading.growth_shares(m.pop_snapshots, m.as_of)
    return shares.select("card_id", money.gem_trend(F.col("share_90"), F.col("share_365")).alias("factor"))


@query("f36_grading_ev_formula", """
select card_id, 0.4 * p10_price + 0.6 * p9_price - 24.99 ev from graded_prices""", ev=4)
def _(m):
    p = grading.graded_prices(m.tx_clean, m.as_of)
    return p.select("card_id", money.grading_ev(F.lit(0.4), F.col("p10_price"), F.col("p9_price"), F.lit(24.99), F.lit(None)).alias("ev"))


@query("p12_ev_gate", "select card_id, ev_per_dollar from grading_ev where sample_size >= 10 and raw_price is not null and ev_per_dollar >= 0.15", ev_per_dollar=4)
def _(m):
    return grading.ev_gate(_ev(m)).select("card_id", "ev_per_dollar")


@query("d14_grading_candidates", "select * from grading_ev where sample_size >= 10 and raw_price is not null and ev_per_dollar >= 0.15", **EV)
def _(m):
    return grading.grading_candidates(grading.graded_prices(m.tx_clean, m.as_of), m.pop_snapshots, m.tx_clean, m.as_of)


# The test market counts few copies a card, so the usual gate lets nothing through; a lower one does.
LOW_GATE = GradingGate(min_sample=2)
_LOW_SQL = "sample_size >= 2 and raw_price is not null and ev_per_dollar >= 0.15"


@query("p12_ev_gate_of_small_samples", f"select card_id, ev_per_dollar from grading_ev where {_LOW_SQL}", ev_per_dollar=4)
def _(m):
    return grading.ev_gate(_ev(m), LOW_GATE).select("card_id", "ev_per_dollar")


@query("d14_grading_candidates_of_small_samples", f"select * from grading_ev where {_LOW_SQL}", **EV)
def _(m):
    return grading.grading_candidates(grading.graded_prices(m.tx_clean, m.as_of), m.pop_snapshots, m.tx_clean, m.as_of, gate=LOW_GATE)


@query("t06_ev_ranking", "select card_id, ev_per_dollar from grading_ev order by ev_per_dollar desc nulls last, card_id limit 25", ev_per_dollar=4)
def _(m):
    return _ev(m).orderBy(F.col("ev_per_dollar").desc_nulls_last(), "card_id").limit(25).select("card_id", "ev_per_dollar")


# --- hedonic ------------------------------------------------------------------------------
view("player_scores", """
select cast(c_custkey % 10 as int) player_id, timestamp '1996-01-01' + cast(150 * (c_custkey % 15) as int) * interval 1 day fit_at,
 avg(c_acctbal) / 10000 premium from customer group by 1, 2""")
view("scoped_sales", """
select t.*, ln(price_usd) log_price from tx_clean t where slab_grader = 'PSA' and slab_grade in (9, 10)""")
view("pop10", "select card_id, snapshot_date, pop_count from pop_snapshots where grade = 10")
view("pop9", "select card_id, snapshot_date, pop_count from pop_snapshots where grade = 9")
view("panel_ts", "select *, cast(as_of_date as timestamp) known_at from factor_panel")
view("feature_base", """
select s.tx_id, s.sold_at, c.player_id, s.log_price, ln(1 + a.pop_count) log_pop_psa10, ln(1 + a.pop_count + b.pop_count) log_pop_psa9_or_better,
 f.parallel_tier, ln(1 + coalesce(c.print_run, a.pop_count + b.pop_count)) print_run_log, s.slab_grade,
 date_diff('day', cast(p.dob as timestamp), s.sold_at) / 365.25 player_age_at_sale, cast(year(s.sold_at) - p.draft_year as int) years_since_draft,
 cast(p.draft_pick as double) draft_pick, z.premium, coalesce(e.cs_momentum_pct, 0.5) cs_momentum_pct,
 ln(1 + coalesce(e.sales_count_90d, 0)) log_sales_count_90d, coalesce(e.bid_ask_proxy, 0) bid_ask_proxy,
 cast(c.is_rookie as int) is_rookie, cast(c.has_auto as int) has_auto, cast(c.has_patch as int) has_patch, cast(c.is_one_of_one as int) is_one_of_one,
 f.era_modern, cast(coalesce(e.is_hyped, false) as int) is_hyped, cast(z.premium is not null as int) has_stardom_score,
 f.set_tier, 'standard' team_market, s.slab_grader, coalesce(e.liquidity_tier, 'D') liquidity_tier
from scoped_sales s join card_master c on c.card_id = s.card_id join player_master p on p.player_id = c.player_id
join card_features f on f.card_id = c.card_id
asof left join pop10 a on a.card_id = s.card_id and s.sold_at >= a.snapshot_date
asof left join pop9 b on b.card_id = s.card_id and s.sold_at >= b.snapshot_date
asof left join panel_ts e on e.card_id = s.card_id and s.sold_at >= e.known_at
asof left join player_scores z on z.player_id = c.player_id and s.sold_at >= z.fit_at""")
view("hedonic_features", """
select * exclude (premium, fill), coalesce(premium, fill) stardom_premium, coalesce(premium, fill) * is_rookie stardom_premium_x_is_rookie,
 0.0 catalyst_score, 0.0 catalyst_score_30d_change
from feature_base, (select coalesce(median(premium) filter (is_rookie = 1 and era_modern = 1), 0) fill from feature_base) m""")
FEATURE_DECIMALS = {c: 6 for c in hedonic.NUMERIC if c not in ("parallel_tier", "years_since_draft", "slab_grade")} | {"log_price": 6}


def _player_scores(m):
    key = F.col("c_custkey")
    fit = dates.ts("1996-01-01") + F.make_dt_interval((150 * (key % 15)).cast("int"))
    return m.raw("customer").groupBy((key % 10).cast("int").alias("player_id"), fit.alias("fit_at")).agg(
        (F.avg("c_acctbal") / 10000).alias("premium"))


def _features(m):
    return hedonic.hedonic_features(m.tx_clean, m.card_master, m.player_master, m.pop_snapshots, m.factor_panel,
                                    _player_scores(m), m.player_events, weeks_in_k)


@query("p05_graded_scope", "select tx_id, log_price from scoped_sales", log_price=7)
def _(m):
    return hedonic.graded_scope(m.tx_clean).select("tx_id", "log_price")


@query("p06_raw_inventory", "select tx_id from tx_clean where slab_grader is null")
def _(m):
    return m.tx_clean.where(F.col("slab_grader").isNull()).select("tx_id")


@query("j01_star_join", """
select tx_id, c.card_year, p.team from tx_clean t join card_master c on c.card_id = t.card_id join player_master p on p.player_id = c.player_id""")
def _(m):
    return hedonic.star(m.tx_clean, m.card_master, m.player_master).select("tx_id", "card_year", "team")


@query("j07_asof_population", """
select s.tx_id, a.pop_count pop_psa10, b.pop_count pop_psa9 from scoped_sales s
asof left join pop10 a on a.card_id = s.card_id and s.sold_at >= a.snapshot_date
asof left join pop9 b on b.card_id = s.card_id and s.sold_at >= b.snapshot_date""")
def _(m):
    out = hedonic.with_card_history(hedonic.graded_scope(m.tx_clean).select("tx_id", "card_id", "sold_at"), hedonic.populations(m.pop_snapshots))
    return out.select("tx_id", "pop_psa10", "pop_psa9")


@query("j08_asof_panel", """
select s.tx_id, e.cs_momentum_pct, e.liquidity_tier, e.sales_count_90d from scoped_sales s
asof left join panel_ts e on e.card_id = s.card_id and s.sold_at >= e.known_at""", cs_momentum_pct=6)
def _(m):
    out = hedonic.with_card_history(hedonic.graded_scope(m.tx_clean).select("tx_id", "card_id", "sold_at"), hedonic.factor_rows(m.factor_panel))
    return out.select("tx_id", "cs_momentum_pct", "liquidity_tier", "sales_count_90d")


@query("j09_asof_player_score", """
select s.tx_id, z.premium stardom_premium, z.premium is not null has_score
from (select t.*, c.player_id from tx_clean t join card_master c on c.card_id = t.card_id) s
asof left join player_scores z on z.player_id = s.player_id and s.sold_at >= z.fit_at""", stardom_premium=6)
def _(m):
    sales = m.tx_clean.join(m.card_master.select("card_id", "player_id"), "card_id").select("tx_id", "player_id", "sold_at")
    out = hedonic.with_player_score(sales, _player_scores(m))
    return out.select("tx_id", "stardom_premium", F.col("stardom_premium").isNotNull().alias("has_score"))


@query("a19_cohort_median", "select median(premium) filter (is_rookie = 1 and era_modern = 1) fill from feature_base", fill=6)
def _(m):
    from slabmill.operators.ordering import exact_quantiles

    sales = hedonic.star(hedonic.graded_scope(m.tx_clean), m.card_master, m.player_master)
    scored = hedonic.with_player_score(sales, _player_scores(m))
    cohort = scored.where(F.col("is_rookie") & (F.col("card_year") >= 2010) & F.col("stardom_premium").isNotNull())
    return exact_quantiles(cohort, [], "stardom_premium", {"fill": 0.5})


@query("d09_hedonic_features", "select * from hedonic_features", **FEATURE_DECIMALS)
def _(m):
    return _features(m)


@query("d09_catalyst_features", """
with d as (select distinct player_id, date_trunc('day', event_date) as day from player_events), s as (
 select d.player_id, d.day, round(coalesce(sum(w * pow(0.5, (epoch_us(d.day) - epoch_us(event_date)) / 86400e6 / h)), 0), 6) a
 from d left join event_mass e on e.player_id = d.player_id and event_date <= d.day and event_date >= d.day - interval 90 day group by 1, 2),
p as (select d.player_id, d.day, round(coalesce(sum(w * pow(0.5, (epoch_us(d.day - interval 30 day) - epoch_us(event_date)) / 86400e6 / h)), 0), 6) b
 from d left join event_mass e on e.player_id = d.player_id and event_date <= d.day - interval 30 day and event_date >= d.day - interval 120 day group by 1, 2)
select event_id, a catalyst_score, a - b catalyst_score_30d_change from player_events e join s on s.player_id = e.player_id and s.day = date_trunc('day', event_date)
join p on p.player_id = e.player_id and p.day = s.day""", catalyst_score=6, catalyst_score_30d_change=6)
def _(m):
    base = m.player_events.select("event_id", "player_id", F.col("event_date").alias("sold_at"))
    out = hedonic.with_catalyst(base, m.player_events, weeks_in_k)
    return out.select("event_id", "catalyst_score", "catalyst_score_30d_change")


view("mispricing", """
select tx_id, 'group_mean' model_version, round(pred - log_price, 6) residual, round(pred, 6) predicted_log_price
from (select *, avg(log_price) over (partition by slab_grade, parallel_tier) pred from feature_base) f""")


def _group_mean_predictions(m):
    tier = cards.parallel_tier(F.col("is_one_of_one"), F.col("print_run"), F.col("parallel"))
    base = hedonic.star(hedonic.graded_scope(m.tx_clean), m.card_master, m.player_master).withColumn("parallel_tier", tier)
    # 2 grades x 6 tiers at most.
    means = base.groupBy("slab_grade", "parallel_tier").agg(F.avg("log_price").alias("predicted_log_price"))
    return base.join(F.broadcast(means), ["slab_grade", "parallel_tier"])


def group_mean_residuals(m):
    return hedonic.mispricing_residuals(_group_mean_predictions(m), "group_mean")


@query("d11_mispricing_residuals", "select * from mispricing", residual=6, predicted_log_price=6)
def _(m):
    return group_mean_residuals(m)


@query("a18_regression_metrics", """
select count(*) n, avg(abs(log_price - predicted_log_price)) mae,
 1 - sum((log_price - predicted_log_price) ** 2) / (var_pop(log_price) * count(log_price)) r2
from mispricing join scoped_sales using (tx_id)""", mae=5, r2=5)
def _(m):
    return hedonic.regression_metrics(_group_mean_predictions(m), guess="predicted_log_price")


view("mispricing_by_card", f"""
select k.card_id, mispricing_residual, computed_at, 'NBA' sport, parallel_tier from (
 select card_id, arg_max(residual, (sold_at, tx_id, residual)) mispricing_residual, max(sold_at) computed_at
 from mispricing join tx_clean using (tx_id) where sold_at < {AS_OF} group by card_id) k join card_features f on f.card_id = k.card_id""")


def mispricing_by_card(m):
    return hedonic.mispricing_by_card(group_mean_residuals(m), m.tx_clean, m.card_master, m.as_of)


@query("d12_mispricing_by_card", "select * from mispricing_by_card", mispricing_residual=6)
def _(m):
    return mispricing_by_card(m)


@query("w04_latest_row", f"""
select card_id, tx_id, sold_at from (select *, row_number() over (partition by card_id order by sold_at desc, tx_id desc) r from tx_clean where sold_at < {AS_OF}) t where r = 1""")
def _(m):
    from slabmill.operators.asof import asof_slice, latest_by

    return latest_by(asof_slice(m.tx_clean, "sold_at", m.as_of).select("card_id", "tx_id", "sold_at"), ["card_id"], ["sold_at", "tx_id"])


@query("p13_lookahead_assert", f"select tx_id, sold_at from tx_clean where sold_at < {AS_OF}")
def _(m):
    from slabmill.operators.asof import asof_slice

    return hedonic.assert_no_lookahead(asof_slice(m.tx_clean, "sold_at", m.as_of), "sold_at", m.as_of).select("tx_id", "sold_at")


@query("d10_time_cutoff", "select to_timestamp(quantile_cont(epoch(sold_at), 0.8)) at time zone 'UTC' cutoff from scoped_sales")
def _(m):
    return hedonic.time_cutoff(hedonic.graded_scope(m.tx_clean))


def _model_predictions(m):
    features = m.stored("hedonic_features", lambda: _features(m))
    fit = hedonic.hedonic_fit(features)
    return hedonic.hedonic_predict(fit.model, features).select("tx_id", "sold_at", "slab_grade", "parallel_tier", "log_price", "predicted_log_price", F.lit(fit.cutoff).cast("timestamp").alias("cutoff"))


@query("d10_hedonic_predictions", predicted_log_price=4)
def _(m):
    return m.stored("hedonic_predictions", lambda: _model_predictions(m)).select("tx_id", "log_price", "predicted_log_price")


@query("d10_fit_quality", """
with c as (select to_timestamp(quantile_cont(epoch(sold_at), 0.8)) at time zone 'UTC' cutoff from hedonic_features)
select count(*) n, count(*) filter (sold_at >= cutoff) n_holdout, true beats_group_mean, round(avg(log_price), 6) mean_log_price from hedonic_features, c""", mean_log_price=5)
def _(m):
    """The fitted model covers every feature row, splits by time and predicts better than the mean of grade and scarcity."""
    rows = m.stored("hedonic_predictions", lambda: _model_predictions(m))
    means = rows.groupBy("slab_grade", "parallel_tier").agg(F.avg("log_price").alias("mean"))
    error = lambda c: F.avg(F.abs(F.col(c) - F.col("log_price")))
    return rows.join(means, ["slab_grade", "parallel_tier"]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sold_at") >= F.col("cutoff")).alias("n_holdout"),
        (error("predicted_log_price") < error("mean")).alias("beats_group_mean"), F.avg("log_price").alias("mean_log_price"),
    )

