"""Prospect cohort, ranker and consensus queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabmill import config
from slabmill.catalog.q_text import _pick, _sql_list
from slabmill.catalog.registry import query, view
from slabmill.functions import dates
from slabmill.functions import scouting as sc
from slabmill.operators.concordance import concordance, concordance_share
from slabmill.plans import scouting
from slabmill.sources import cohorts

YEARS = list(range(2010, 2025))
LEAGUES = ("euroleague", "eurocup", "acb", "nbl")
view("ncaa", """
select c_name br_slug, 'N' || c_custkey as name, cast(2010 + c_custkey % 15 as int) draft_year, case when c_custkey % 5 <> 0 then cast(1 + c_custkey % 60 as double) end draft_pick,
 ['PG', 'G', 'SF', 'F', 'C', 'pf'][1 + c_custkey % 6] as position, c_acctbal / 400 usg_pct, c_acctbal / 900 trb_pct from customer where c_custkey % 2 = 0""")
view("gleague", """
select c_name br_slug, 'G' || c_custkey as name, (2009 + c_custkey % 15) || '-' || lpad(cast((2010 + c_custkey % 15) % 100 as varchar), 2, '0') season, 20.5 age, c_acctbal / 300 usg_pct
from customer where c_custkey % 3 = 0""")
view("euro", f"""
select c_name br_slug, 'E' || c_custkey as name, {_sql_list(LEAGUES)}[1 + c_custkey % 4] league, (2009 + c_custkey % 15) || '-' || lpad(cast((2010 + c_custkey % 15) % 100 as varchar), 2, '0') season,
 '19.5' age, c_acctbal / 200 usg_pct from customer where c_custkey % 5 = 0""")


def _frames(m):
    c, key, bal = m.raw("customer"), F.col("c_custkey"), F.col("c_acctbal")
    season = dates.season_label((2009 + key % 15).cast("int"))
    ncaa = c.where(key % 2 == 0).select(
        F.col("c_name").alias("br_slug"), F.concat(F.lit("N"), key).alias("name"), (2010 + key % 15).cast("int").alias("draft_year"),
        F.when(key % 5 != 0, (1 + key % 60).cast("double")).alias("draft_pick"), _pick(("PG", "G", "SF", "F", "C", "pf"), key % 6).alias("position"),
        (bal / 400).alias("usg_pct"), (bal / 900).alias("trb_pct"),
    )
    gleague = c.where(key % 3 == 0).select(
        F.col("c_name").alias("br_slug"), F.concat(F.lit("G"), key).alias("name"), season.alias("season"), F.lit(20.5).alias("age"), (bal / 300).alias("usg_pct")
    )
    euro = c.where(key % 5 == 0).select(
        F.col("c_name").alias("br_slug"), F.concat(F.lit("E"), key).alias("name"), _pick(LEAGUES, key % 4).alias("league"), season.alias("season"),
        F.lit("19.5").alias("age"), (bal / 200).alias("usg_pct"),
    )
    return ncaa, gleague, euro


_origin = "case league when 'euroleague' then 'EUROLEAGUE' when 'acb' then 'LIGA_ACB' when 'nbl' then 'NBL' else 'OTHER_INTL' end"
view("cohort_union", f"""
select br_slug, name, draft_year, draft_pick, position, null::double age_at_draft, usg_pct, trb_pct, 'NCAA' prospect_origin, 0 pr, null season from ncaa union all
select br_slug, name, cast(left(season, 4) as int) + 1, null, null, age, usg_pct, null, 'GLEAGUE', 1, season from gleague union all
select br_slug, name, cast(left(season, 4) as int) + 1, null, null, cast(age as double), usg_pct, null, {_origin}, case league when 'euroleague' then 2 else 3 end, season from euro""")
_mle = "case prospect_origin " + " ".join(f"when '{n}' then {m}" for n, m, _ in config.LEAGUE_EQUIVALENCY) + " end"
_str = "case prospect_origin " + " ".join(f"when '{n}' then {r}" for n, _, r in config.LEAGUE_EQUIVALENCY) + " end"
view("unified", f"""
select br_slug, name, draft_year, draft_pick, position, age_at_draft, trb_pct * {_mle} trb_pct, usg_pct * {_mle} usg_pct, prospect_origin, cast(n as int) years_in_prior_league,
 cast({_mle} as double) prior_league_mle_score, {_str} prior_league_strength_rank
from (select *, row_number() over (partition by br_slug, draft_year order by pr, season, name) r, count(*) over (partition by br_slug, draft_year) n from cohort_union) u where r = 1""")
UNI = "br_slug, name, draft_year, draft_pick, position, age_at_draft, trb_pct, usg_pct, prospect_origin, years_in_prior_league, prior_league_mle_score, prior_league_strength_rank"


def unified(m):
    return scouting.unified_cohort(*_frames(m), YEARS)


@query("d34_unified_cohort", f"select {UNI} from unified", trb_pct=7, usg_pct=7)
def _(m):
    return unified(m).select(*UNI.split(", "))


@query("set01_union_aligned", "select prospect_origin, count(*) n, sum(usg_pct) total from cohort_union group by 1", total=4)
def _(m):
    ncaa, gleague, euro = _frames(m)
    parts = [ncaa.withColumn("prospect_origin", F.lit("NCAA")), gleague.withColumn("prospect_origin", F.lit("GLEAGUE")),
             euro.withColumn("prospect_origin", sc.league_origin(F.col("league")))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2].withColumn("age", F.col("age").cast("double")), allowMissingColumns=True)
    return both.groupBy("prospect_origin").agg(F.count(F.lit(1)).alias("n"), F.sum("usg_pct").alias("total"))


@query("p14_season_filter", "select br_slug, season, cast(left(season, 4) as int) + 1 draft_year from gleague where cast(left(season, 4) as int) + 1 in (2012, 2013)")
def _(m):
    return scouting.season_filter(_frames(m)[1], [2012, 2013]).select("br_slug", "season", "draft_year")


@query("a23_origin_counts", "select br_slug, draft_year, count(*) n from cohort_union group by 1, 2")
def _(m):
    ncaa, gleague, euro = _frames(m)
    keys = ncaa.select("br_slug", "draft_year")
    for f in (gleague, euro):
        keys = keys.union(scouting.season_filter(f, YEARS).select("br_slug", "draft_year"))
    return keys.groupBy("br_slug", "draft_year").agg(F.count(F.lit(1)).alias("n"))


@query("a24_cohort_coverage", """
select prospect_origin, count(*) n_rows, count(distinct draft_year) n_classes, count(distinct draft_year) < 5 too_few from unified group by 1""")
def _(m):
    return scouting.cohort_coverage(unified(m))


@query("f29_league_scaling", f"select br_slug, prospect_origin, usg_pct * {_mle} usg_pct, {_mle} mle from prospects", usg_pct=8, mle=2)
def _(m):
    out = scouting.scale_to_college(m.prospects)
    return out.select("br_slug", "prospect_origin", "usg_pct", F.col("prior_league_mle_score").alias("mle"))


# --- measurements --------------------------------------------------------------------
view("combine", """
select c_name br_slug, case when c_custkey % 4 = 0 then 70 + c_custkey % 15 end height_no_shoes, 71.0 + c_custkey % 15 height_with_shoes, 180.0 + c_custkey % 80 weight,
 74.0 + c_custkey % 17 wingspan, 96.0 + c_custkey % 14 standing_reach, case when c_custkey % 7 <> 0 then 30.0 + c_custkey % 12 end max_vertical,
 10.5 + c_custkey % 20 / 10.0 lane_agility_time, 3.0 + c_custkey % 9 / 10.0 three_quarter_sprint from customer where c_custkey % 3 <> 1""")


def _combine(m):
    key = F.col("c_custkey")
    return m.raw("customer").where(key % 3 != 1).select(
        F.col("c_name").alias("br_slug"), F.when(key % 4 == 0, (70 + key % 15).cast("double")).alias("height_no_shoes"), (71.0 + key % 15).alias("height_with_shoes"),
        (180.0 + key % 80).alias("weight"), (74.0 + key % 17).alias("wingspan"), (96.0 + key % 14).alias("standing_reach"),
        F.when(key % 7 != 0, 30.0 + key % 12).alias("max_vertical"), (10.5 + key % 20 / 10.0).alias("lane_agility_time"), (3.0 + key % 9 / 10.0).alias("three_quarter_sprint"),
    )


view("measured", """
select p.br_slug, wingspan - coalesce(height_no_shoes, height_with_shoes) wingspan_minus_height, 703.0 * weight / pow(coalesce(height_no_shoes, height_with_shoes), 2) bmi,
 standing_reach, max_vertical, lane_agility_time, three_quarter_sprint from prospects p left join combine c on c.br_slug = p.br_slug""")
_fills = ", ".join(f"coalesce({c}, (select median({c}) from measured), 0) {c}, cast({c} is null as int) combine_{c}_imputed" for c in scouting.COMBINE)
view("combine_filled", f"select br_slug, {_fills}, cast(coalesce({', '.join(scouting.COMBINE)}) is not null as int) has_combine_data from measured")
MEAS = {c: 9 for c in scouting.COMBINE}


@query("d35_combine_features", "select * from combine_filled", **MEAS)
def _(m):
    return scouting.combine_features(m.prospects.select("br_slug"), _combine(m))


@query("a20_median_fill_table", "select " + ", ".join(f"median({c}) {c}" for c in scouting.COMBINE) + " from measured", **MEAS)
def _(m):
    height = F.coalesce("height_no_shoes", "height_with_shoes")
    joined = m.prospects.select("br_slug").join(_combine(m), "br_slug", "left").withColumn("wingspan_minus_height", F.col("wingspan") - height)
    med = scouting.column_medians(joined.withColumn("bmi", sc.bmi(F.col("weight"), height)), scouting.COMBINE)
    return med.agg(*[F.max(F.when(F.col("feature") == c, F.col("med"))).alias(c) for c in scouting.COMBINE])


@query("j19_first_match_left_join", "select p.br_slug, c.weight from prospects p left join combine c on c.br_slug = p.br_slug", weight=3)
def _(m):
    from slabmill.operators.asof import first_by

    twice = _combine(m).unionByName(_combine(m).withColumn("weight", F.col("weight") + 500))
    one = first_by(twice, ["br_slug"], ["weight", "wingspan"])
    return m.prospects.select("br_slug").join(one.select("br_slug", "weight"), "br_slug", "left")


@query("set07_first_duplicate_wins", "select br_slug, weight from combine", weight=3)
def _(m):
    from slabmill.operators.asof import first_by

    twice = _combine(m).unionByName(_combine(m).withColumn("weight", F.col("weight") + 500))
    return first_by(twice, ["br_slug"], ["weight", "wingspan"]).select("br_slug", "weight")


@query("f26_height_inches", """
select c_custkey, case c_custkey % 3 when 0 then (5 + c_custkey % 2) * 12 + c_custkey % 12 + 0.25 when 1 then 70.0 + c_custkey % 15 end inches from customer""", inches=4)
def _(m):
    key = F.col("c_custkey")
    text = F.when(key % 3 == 0, F.concat((5 + key % 2).cast("string"), F.lit("-"), (key % 12).cast("string"), F.lit(".25"))).when(
        key % 3 == 1, (70 + key % 15).cast("string")
    ).otherwise("--")
    return m.raw("customer").select("c_custkey", sc.height_inches(text).alias("inches"))


@query("f27_measurement_math", "select br_slug, wingspan_minus_height, bmi from measured", wingspan_minus_height=9, bmi=9)
def _(m):
    h = F.coalesce("height_no_shoes", "height_with_shoes")
    joined = m.prospects.select("br_slug").join(_combine(m), "br_slug", "left")
    return joined.select("br_slug", (F.col("wingspan") - h).alias("wingspan_minus_height"), sc.bmi(F.col("weight"), h).alias("bmi"))


# --- matrix and ranker ---------------------------------------------------------------------
view("matrix", """
select br_slug, draft_year, greatest(career_bpm_5y, 0) target, usg_pct, coalesce(cast(draft_pick as double), 61.0) draft_pick, ln(1 + coalesce(draft_pick, 61)) log_draft_pick,
 coalesce(cast(draft_pick as double), 61.0) mock_rank, cast(prospect_origin = 'NCAA' as int) "origin_NCAA", cast(prospect_origin = 'GLEAGUE' as int) "origin_GLEAGUE",
 cast(prospect_origin = 'EUROLEAGUE' as int) "origin_EUROLEAGUE", 1.0::double prior_league_mle_score from prospects""")
MX = ["br_slug", "draft_year", "target", "usg_pct", "draft_pick", "log_draft_pick", "mock_rank", "origin_NCAA", "origin_GLEAGUE", "origin_EUROLEAGUE", "prior_league_mle_score"]


def matrix(m):
    return scouting.prospect_matrix(m.prospects, m.prospects.select("br_slug", "career_bpm_5y"))


@query("d36_prospect_matrix", "select * from matrix", target=7, usg_pct=7, log_draft_pick=7)
def _(m):
    return matrix(m).select(*MX)


@query("f34_clipped_outcome", "select br_slug, target from matrix", target=7)
def _(m):
    return matrix(m).select("br_slug", "target")


@query("f28_one_hot", """
select br_slug, cast(pos = 'PG' as int) "pos_PG", cast(pos = 'SG' as int) "pos_SG", cast(pos = 'SF' as int) "pos_SF", cast(pos = 'PF' as int) "pos_PF", cast(pos = 'C' as int) "pos_C"
from (select br_slug, case upper(position) when 'G' then 'SG' when 'F' then 'SF' else upper(position) end pos from ncaa) n""")
def _(m):
    return _frames(m)[0].select("br_slug", *sc.one_hot(sc.position(F.col("position")), config.POSITIONS, "pos"))


view("class_pairs", """
select a.draft_year, count(*) comparable, count(*) filter ((a.target - b.target) * (a.usg_pct - b.usg_pct) > 0) agree
from matrix a join matrix b on a.draft_year = b.draft_year and a.br_slug < b.br_slug and a.target <> b.target group by 1""")


@query("j20_comparable_pairs", "select draft_year, comparable, agree from class_pairs")
def _(m):
    return concordance(matrix(m), "target", "usg_pct", ["draft_year"])


@query("a36_concordance", "select sum(agree) / sum(comparable) concordance from class_pairs", concordance=8)
def _(m):
    return concordance_share(matrix(m), "target", "usg_pct", ["draft_year"])


RANKER_FEATURES = ["usg_pct", "draft_pick", "log_draft_pick", "origin_GLEAGUE", "origin_EUROLEAGUE"]


@query("d37_pairwise_ranker", score=5)
def _(m):
    data = m.stored("matrix", lambda: matrix(m))
    weights = scouting.pairwise_rank_fit(data, RANKER_FEATURES)
    return data.select("br_slug", "draft_year", scouting.rank_score(weights).alias("score"))


@query("d37_holdout_concordance", concordance=5)
def _(m):
    data = m.stored("matrix", lambda: matrix(m))
    return scouting.holdout_concordance(data, scouting.pairwise_rank_fit(data, RANKER_FEATURES))


def _tie(col, part):
    return f"(rank() over (partition by {part} order by {col}) + (count(*) over (partition by {part}, {col}) - 1) / 2.0) / count({col}) over (partition by {part})"


view("premiums", f"""
select br_slug, draft_year, pr - (1 - pk) premium, pr percentile_rank from (select *, {_tie('usg_pct', 'draft_year')} pr, {_tie('pick', 'draft_year')} pk
 from (select br_slug, draft_year, usg_pct, coalesce(draft_pick, (select max(draft_pick) from prospects)) pick from prospects) x) y""")


def _premiums(m):
    return scouting.stardom_premium(m.prospects.withColumn("model_score", F.col("usg_pct")))


@query("d38_stardom_premium", "select * from premiums", premium=7, percentile_rank=7)
def _(m):
    return _premiums(m)


view("slug_players", "select c_name br_slug, cast(c_custkey as int) player_id from customer where c_custkey % 4 <> 0")


def _slug_players(m):
    return m.raw("customer").where("c_custkey % 4 <> 0").select(F.col("c_name").alias("br_slug"), F.col("c_custkey").cast("int").alias("player_id"))


@query("d39_scores_to_store", """
select player_id, draft_year, 'pairwise_v1' model_version, round(premium, 4) premium, round(percentile_rank, 4) percentile_rank, timestamp '2024-01-01' fit_at
from premiums join slug_players using (br_slug)""", premium=4, percentile_rank=4)
def _(m):
    return scouting.scores_to_store(_premiums(m), _slug_players(m), "pairwise_v1", dates.ts("2024-01-01"))[0]


@query("d39_skip_counts", """
select count(player_id) stored, count(*) - count(player_id) unmapped, cast(0 as bigint) bad_year from premiums left join slug_players using (br_slug)""")
def _(m):
    return scouting.scores_to_store(_premiums(m), _slug_players(m), "pairwise_v1", dates.ts("2024-01-01"))[1]


# --- consensus and forward scores --------------------------------------------------------------
view("consensus", """
select br_slug, median(mock_rank) consensus_rank, count(*) sources_count, quantile_cont(mock_rank, 0.75) - quantile_cont(mock_rank, 0.25) rank_dispersion
from mock_ranks group by 1 having count(*) >= 3""")


def consensus(m):
    return scouting.consensus_rank(m.mock_ranks.withColumn("player_name", F.col("br_slug")))


@query("a21_consensus_rank", "select * from consensus", consensus_rank=4, rank_dispersion=4)
def _(m):
    return consensus(m).drop("player_name")


# Each source publishes on several days; only its newest list by the as-of date counts.
view("dated_mocks", """
select source, br_slug, mock_rank + d mock_rank, 2026 draft_year, date '2026-01-01' + cast(d * 10 + length(source) as int) snapshot_date from mock_ranks, (values (0), (1), (2)) v(d)""")


def _dated_mocks(m):
    d = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("d")
    return m.mock_ranks.select("source", "br_slug", "mock_rank", d).select(
        "source", "br_slug", (F.col("mock_rank") + F.col("d")).alias("mock_rank"), F.lit(2026).alias("draft_year"),
        F.date_add(F.lit("2026-01-01").cast("date"), F.col("d") * 10 + F.length("source")).alias("snapshot_date"),
    )


@query("s09_latest_snapshots", """
select source, br_slug, mock_rank from dated_mocks d where snapshot_date = (select max(snapshot_date) from dated_mocks x where x.source = d.source and x.snapshot_date <= date '2026-01-15')""")
def _(m):
    return cohorts.latest_snapshots(_dated_mocks(m), F.lit("2026-01-15").cast("date")).select("source", "br_slug", "mock_rank")


@query("d41_consensus_as_of", """
with l as (select source, br_slug, mock_rank from dated_mocks d where snapshot_date = (select max(snapshot_date) from dated_mocks x where x.source = d.source and x.snapshot_date <= date '2026-01-15'))
select br_slug, median(mock_rank) consensus_rank, count(*) sources_count from l group by 1 having count(*) >= 3""", consensus_rank=4)
def _(m):
    newest = cohorts.latest_snapshots(_dated_mocks(m), F.lit("2026-01-15").cast("date"))
    return scouting.consensus_rank(newest.withColumn("player_name", F.col("br_slug"))).select("br_slug", "consensus_rank", "sources_count")


view("current_class", """
select c_name br_slug, 'P' || c_custkey as name, ['FR', 'SO', 'JR', 'SR'][1 + c_custkey % 4] class_year, 'NCAA' prior_league, cast(20 + c_custkey % 15 as int) n_games_played,
 c_acctbal / 400 usg_pct, case when c_custkey % 2 = 0 then 2026 else 2027 end draft_year from customer""")
view("forward", f"""
select br_slug, name, 2026 draft_year, date '2026-01-15' as_of_date, round(0.03 * usg_pct - 0.5, 9) pairwise_score, consensus_rank, sources_count, class_year in ('FR', 'SO') is_underclassman,
 case class_year when 'FR' then 2 when 'SO' then 1 else 0 end years_until_draft, prior_league, n_games_played, pp pairwise_pct, cp consensus_pct, pp - (1 - cp) premium
from (select *, {_tie('usg_pct', '1')} pp, case when consensus_rank is not null then {_tie('consensus_rank', 'consensus_rank is null')} end cp
 from (select c.*, k.consensus_rank, k.sources_count from current_class c left join consensus k on k.br_slug = c.br_slug where draft_year = 2026) x) y""")
FW = {"pairwise_score": 9, "consensus_rank": 3, "pairwise_pct": 7, "consensus_pct": 7, "premium": 7}


def forward(m):
    key = F.col("c_custkey")
    current = m.raw("customer").select(
        F.col("c_name").alias("br_slug"), F.concat(F.lit("P"), key).alias("name"), _pick(("FR", "SO", "JR", "SR"), key % 4).alias("class_year"),
        F.lit("NCAA").alias("prior_league"), (20 + key % 15).cast("int").alias("n_games_played"), (F.col("c_acctbal") / 400).alias("usg_pct"),
        F.when(key % 2 == 0, 2026).otherwise(2027).alias("draft_year"),
    )
    weights = {"usg_pct": 0.03, "draft_pick": -0.5 / 61.0}
    return scouting.forward_scores(current, weights, consensus(m), 2026, F.lit("2026-01-15").cast("date"))


@query("d40_forward_scores", "select * from forward", **FW)
def _(m):
    return forward(m)


@query("f03_expected_draft_year", """
select c_custkey, 2000 + c_custkey % 30 + 1 + case c_custkey % 5 when 0 then 2 when 1 then 1 else 0 end draft_year from customer""")
def _(m):
    key = F.col("c_custkey")
    season = dates.season_label((2000 + key % 30).cast("int"))
    return m.raw("customer").select("c_custkey", sc.expected_draft_year(season, _pick(("fr", "SO", "JR", "SR", ""), key % 5)).cast("bigint").alias("draft_year"))


# --- cohorts and outcomes -------------------------------------------------------------------------
SEASON_ROWS = T.StructType([T.StructField("br_slug", T.StringType()), T.StructField("sos", T.DoubleType()), T.StructField("usg_pct", T.DoubleType()), T.StructField("years_in_prior_league", T.IntegerType())])


@query("s11_normalize_frame", "select br_slug, cast(null as double) sos, usg_pct, 1 years_in_prior_league from ncaa", usg_pct=8)
def _(m):
    text = _frames(m)[0].withColumn("usg_pct", F.col("usg_pct").cast("string"))
    return cohorts.normalize_frame(text, SEASON_ROWS, {"years_in_prior_league": 1})


@query("j18_dynamic_key_join", """
select p.name, p.team, p.pts, a.pts pts_adv, a.bpm from (select c_name as name, c_mktsegment team, c_acctbal pts from customer) p
left join (select c_name as name, c_mktsegment team, c_acctbal + 1 pts, c_acctbal / 2 bpm from customer where c_custkey % 2 = 0) a on a.name = p.name and a.team = p.team""", pts=3, pts_adv=3, bpm=4)
def _(m):
    c = m.raw("customer")
    per_game = c.select(F.col("c_name").alias("Player"), F.col("c_mktsegment").alias("Team"), F.col("c_acctbal").alias("PTS"))
    adv = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("Player"), F.col("c_mktsegment").alias("Team"), (F.col("c_acctbal") + 1).alias("PTS"), (F.col("c_acctbal") / 2).alias("BPM"))
    return cohorts.merge_on_shared_keys(per_game, adv)


@query("a22_outcome_sums", """
select br_slug, sum(bpm) career_bpm_5y, sum(ws) career_ws_5y, sum(vorp) career_vorp_5y from (
 select *, row_number() over (partition by br_slug order by row_no) i from (
 select 'u' || user_id br_slug, event_id row_no, value bpm, value / 2 ws, case when event_id % 5 = 0 then 0 else 1.5 end vorp from events where event_type <> 'error') e) x where i <= 5 group by 1""",
       career_bpm_5y=5, career_ws_5y=5, career_vorp_5y=5)
def _(m):
    e = m.raw("events").select(
        F.concat(F.lit("u"), "user_id").alias("br_slug"), F.col("event_id").alias("row_no"), F.when(F.col("event_type") == "error", "partial_table").alias("row_class"),
        F.col("value").alias("bpm"), (F.col("value") / 2).alias("ws"), F.when(F.col("event_id") % 5 != 0, 1.5).alias("vorp"),
    )
    return scouting.career_outcomes(e)


@query("d57_career_outcomes", """
select 'u' || user_id || '-' || event_id // 100 br_slug, sum(value) career_bpm_5y from (
 select *, row_number() over (partition by user_id, event_id // 100 order by event_id) i from events where event_type <> 'error') x where i <= 5 group by 1""", career_bpm_5y=5)
def _(m):
    from slabmill.sources.html import explode_html_rows

    row = F.concat(
        F.lit("<tr"), F.when(F.col("event_type") == "error", ' class="partial_table"').otherwise(""), F.lit('><th data-stat="season">'), F.col("event_id").cast("string"),
        F.lit('</th><td data-stat="bpm">'), F.col("value").cast("string"), F.lit("</td></tr>"),
    )
    # A page takes its rows from one hundred event ids, so it stays small.
    slug = F.concat(F.lit("u"), "user_id", F.lit("-"), F.floor(F.col("event_id") / 100))
    pages = m.raw("events").groupBy(slug.alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", row.alias("r")))).alias("rs")).select(
        "page_id", F.concat(F.lit('<!-- <table id="advanced"><tbody>'), F.array_join(F.col("rs.r"), ""), F.lit("</tbody></table> -->")).alias("html")
    )
    return scouting.career_outcomes(scouting.outcome_rows(explode_html_rows(pages))).select("br_slug", "career_bpm_5y")
