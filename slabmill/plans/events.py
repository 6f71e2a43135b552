"""Feeds to player events: names, injuries, schedule, awards, transactions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabmill.functions import dates, event_text, names
from slabmill.operators.asof import even_pieces, first_by, next_row, running_count
from slabmill.session import stage

EVENT_KEY = ["player_id", "event_type", "event_date"]
SIMILARITY_FLOOR = 0.88
#: Rows of a key that meet its roster together.
RUN = 256


def resolve_names(feed: DataFrame, player: DataFrame, column: str = "player_name", floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """Add player_id to each feed name: exact, then accent-free, then best similar name.

    Only distinct names that the equality stages leave over reach the fuzzy stage.
    """
    asked = feed.select(F.trim(column).alias("_name")).distinct()
    known = player.select("player_id", "name")
    exact = known.groupBy(F.lower("name").alias("_k")).agg(F.min("player_id").alias("_exact"))
    plain = known.groupBy(names.normalize_name(F.col("name")).alias("_n")).agg(F.min("player_id").alias("_plain"))
    staged = (
        asked.withColumn("_k", F.lower("_name"))
        .withColumn("_n", names.normalize_name(F.col("_name")))
        .join(exact, "_k", "left")
        .join(plain, "_n", "left")
        .withColumn("_found", F.coalesce("_exact", "_plain"))
        .select("_name", "_n", "_found")
    )
    open_names = staged.where(F.col("_found").isNull())

    # Of two names within the floor, one of the known name's pieces is whole in the asked name and hardly moved, so near
    # names meet on equal pieces. Of its pieces a name needs one more than its edits: the rarest ones.
    forms = lambda n: F.explode(F.array_distinct(F.array(names.normalize_name(n), names.sorted_words(n))))
    slack = F.floor(F.length("_form") * ((1 - floor) / floor) + 1e-9)
    known_pieces = (
        known.where("name is not null").select("player_id", "name", forms(F.col("name")).alias("_form"))
        .select("player_id", "name", "_form", slack.alias("_edits"), F.explode(names.pieces(F.col("_form"))).alias("_p"))
        .select("player_id", "name", "_form", "_edits", "_p.piece", "_p.at")
    )
    held = known_pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("_held"))
    rarity = F.row_number().over(Window.partitionBy("player_id", "name", "_form").orderBy("_held", "at"))
    chosen = known_pieces.join(held, "piece").withColumn("_i", rarity).where(F.col("_i") <= F.col("_edits") + 1)
    asked_pieces = (
        open_names.select("_name", forms(F.col("_name")).alias("_asked")).select("_name", "_asked", F.explode(names.stretches(F.col("_asked"))).alias("_q"))
        .select("_name", "_asked", F.col("_q.piece").alias("piece"), F.col("_q.at").alias("_there"))
    )
    near = (F.abs(F.col("at") - F.col("_there")) <= F.col("_edits")) & (F.abs(F.length("_form") - F.length("_asked")) <= F.col("_edits"))
    met = asked_pieces.join(chosen, "piece").where(near).select("_name", "player_id", "name").distinct()
    scored = met.withColumn("_s", names.name_similarity(F.col("_name"), F.col("name")))
    fuzzy = scored.where(F.col("_s") >= floor).groupBy("_name").agg(
        F.min_by("player_id", F.struct(-F.col("_s"), F.col("player_id"))).alias("_fuzzy")
    )
    resolved = staged.join(fuzzy, "_name", "left").select("_name", F.coalesce("_found", "_fuzzy").alias("player_id"))
    keyed = feed.withColumn("_name", F.trim(column))
    return keyed.join(resolved, "_name", "left").drop("_name")


def new_events(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates whose (player, type, date) is new; the first of equal keys wins."""
    fresh = first_by(candidates.select(*EVENT_KEY, "event_payload"), EVENT_KEY, ["event_payload"])
    return fresh.join(stored.select(*EVENT_KEY), EVENT_KEY, "left_anti")


def status_changes(reports: DataFrame, stored: DataFrame) -> DataFrame:
    """Reports that change a player's status; an opening 'return' is not an event.

    ``reports``: player_id, event_type, event_date, seq, event_payload. Each player's
    last stored injury event stands before the batch.
    """
    kinds = event_text.INJURY_TYPES
    start = stored.where(F.col("event_type").isin(*kinds)).groupBy("player_id").agg(F.max_by("event_type", F.struct("event_date", "event_type")).alias("event_type"))
    prior = start.select(
        "player_id", "event_type", dates.ts("1900-01-01").alias("event_date"), F.lit(-1).cast("bigint").alias("seq"),
        F.lit(None).cast("string").alias("event_payload"), F.lit(0).alias("_side"),
    )
    batch = reports.select("player_id", "event_type", "event_date", F.col("seq").cast("bigint").alias("seq"), "event_payload", F.lit(1).alias("_side"))
    both = prior.unionByName(batch.where(F.col("player_id").isNotNull()))
    # Without stored context, 'return' rows before the first injury drop out.
    place = F.struct("event_date", "seq")
    opened = both.groupBy("player_id").agg(
        F.min(F.when((F.col("_side") == 0) | (F.col("event_type") != "injury_return"), place)).alias("_opened")
    )
    usable = both.join(opened, "player_id").where(place >= F.col("_opened")).drop("_opened")
    compared = next_row(usable, ["player_id"], ["event_date", "seq"], {"_before": "event_type"}, back=True)
    changed = compared.where((F.col("_side") == 1) & (F.col("_before").isNull() | (F.col("_before") != F.col("event_type"))))
    return changed.select(*EVENT_KEY, "event_payload")


def injury_events(report: DataFrame, player: DataFrame, stored: DataFrame) -> DataFrame:
    """New injury events of a report (player_name, status, status_date, note, seq)."""
    typed = report.withColumn("event_type", event_text.classify_injury(F.col("status"))).where(F.col("event_type").isNotNull())
    named = resolve_names(typed, player).where(F.col("player_id").isNotNull())
    rows = named.select(
        "player_id", "event_type", F.col("status_date").cast("timestamp").alias("event_date"), "seq",
        F.to_json(F.struct("status", "note")).alias("event_payload"),
    )
    return new_events(status_changes(rows, stored), stored)


# --- schedule ------------------------------------------------------------------------
def schedule_games(team_rows: DataFrame) -> DataFrame:
    """One row per game from its two team rows; games with one row are dropped."""
    home = F.contains("matchup", F.lit("vs."))
    won = F.col("wl") == "W"
    games = team_rows.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("game_date").alias("game_date"),
        F.max(F.when(home, F.col("team"))).alias("home_team"),
        F.max(F.when(~home, F.col("team"))).alias("away_team"),
        F.max(F.when(won, F.col("team"))).alias("winner_team"),
    )
    kind = event_text.game_kind(F.col("game_id"))
    return games.where(F.col("_n") >= 2).drop("_n").withColumn("is_playoff", kind == "playoff").withColumn("is_all_star", kind == "all_star")


def series_tally(games: DataFrame) -> DataFrame:
    """Running wins per season, playoff series and winner."""
    played = games.where(F.col("is_playoff") & F.col("winner_team").isNotNull())
    series = F.concat_ws("-", F.sort_array(F.array("home_team", "away_team")))
    keyed = played.withColumn("series", series).withColumn("season", dates.current_season(F.col("game_date")))
    return running_count(keyed, ["season", "series", "winner_team"], ["game_date", "game_id"], "wins")


def classified_playoffs(games: DataFrame) -> DataFrame:
    """Playoff games with clincher and finals flags; finals = series of the season's last clincher."""
    tally = series_tally(games).withColumn("is_series_clincher", F.col("wins") >= 4)
    finals = tally.where("is_series_clincher").groupBy("season").agg(
        F.max_by("series", F.struct("game_date", "game_id")).alias("finals_series")
    )
    return tally.join(finals, "season", "left").withColumn(
        "is_finals", F.coalesce(F.col("series") == F.col("finals_series"), F.lit(False))
    ).drop("finals_series")


def on_roster(rows: DataFrame, roster: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``rows`` for each roster row (player_id, key) of the same key.

    The result is far larger than either side and has few keys, so runs of at most ``RUN`` rows of a key meet the roster together and are dealt out
    before; the roster goes along whole to each piece where its stored size allows (Spark decides). A player's rows of a run follow each other, in
    the same order for every player, so a columnar file stores them in under a bit a row.
    """
    key = next(c for c in roster.columns if c != "player_id")
    rest = [c for c in rows.columns if c != key]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    pieces = even_pieces(rows.where(F.col(key).isNotNull()), [key], rest)
    place = F.row_number().over(Window.partitionBy("_piece", key).orderBy(*rest))
    runs = pieces.withColumn("_run", F.floor((place - 1) / RUN)).groupBy("_piece", key, "_run").agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    dealt = runs.repartition(parts, "_piece", key, "_run").select(key, "_rows")
    met = dealt.join(stage(roster.where(F.col(key).isNotNull()), "roster"), key)
    return met.select(key, "player_id", F.explode("_rows").alias("_row")).select(key, "player_id", "_row.*").select(*columns)


def playoff_events(games: DataFrame, player: DataFrame, stored: DataFrame) -> DataFrame:
    """One event per playoff win and current roster member of the winner.

    Wins are made one per (team, type, date) before they fan out. Players meet them by the set of teams they are listed for, so the
    events of a player need no second reduction, and only stored keys of a win's type and date are compared with them.
    """
    flagged = classified_playoffs(games)
    clinch = F.col("is_series_clincher")
    kind = F.when(clinch & F.col("is_finals"), "playoff_finals_win").when(clinch, "playoff_series_win").otherwise("playoff_win")
    wins = flagged.select(
        F.col("winner_team").alias("team"), kind.alias("event_type"), F.col("game_date").cast("timestamp").alias("event_date"),
        F.to_json(F.struct("game_id", "season")).alias("event_payload"),
    )
    rest = ["event_type", "event_date"]
    of_team = first_by(wins, ["team", *rest], ["event_payload"])
    listed = player.where(F.col("team").isNotNull()).groupBy("player_id").agg(F.sort_array(F.collect_set("team")).alias("teams"))
    listed = stage(listed, "listed")
    squads = listed.select("teams").distinct().select("teams", F.explode("teams").alias("team"))
    of_squad = stage(first_by(squads.join(of_team, "team").drop("team"), ["teams", *rest], ["event_payload"]), "squad-wins")
    events = on_roster(of_squad, listed, *EVENT_KEY, "event_payload")
    taken = stored.select(*EVENT_KEY).distinct().join(of_squad.select(*rest).distinct(), rest, "left_semi")
    return events.join(stage(taken.select(*EVENT_KEY), "taken"), EVENT_KEY, "left_anti")


# --- awards and transactions ---------------------------------------------------------------
def award_rows(rows: DataFrame, season: Column) -> DataFrame:
    """(award_type, season, player_name) from exploded award tables."""
    single = rows.where(F.col("table_id").isin("mvp", "roy", "dpoy") & F.try_element_at("stats", F.lit("player")).isNotNull())
    body = single.where(F.lower(F.get("cells", F.lit(0))) != "rank")
    first = first_by(
        body.select("page_id", "table_id", "row_no", F.try_element_at("stats", F.lit("player")).alias("player_name")), ["page_id", "table_id"], ["row_no"]
    ).select(F.col("table_id").alias("award_type"), "player_name")
    league = rows.where(F.col("table_id") == "leading_all_nba").select(
        event_text.classify_award_tier(F.try_element_at("stats", F.lit("all_nba_team"))).alias("award_type"),
        F.try_element_at("stats", F.lit("player")).alias("player_name"),
    )
    both = first.unionByName(league.where(F.col("award_type").isNotNull()))
    return both.where(F.col("player_name") != "").select("award_type", season.alias("season"), "player_name")


def award_events(rows: DataFrame, player: DataFrame, stored: DataFrame) -> DataFrame:
    valid = rows.where(F.col("award_type").isin(*event_text.AWARD_TYPES))
    named = resolve_names(valid, player).where(F.col("player_id").isNotNull())
    events = named.select(
        "player_id", F.col("award_type").alias("event_type"), dates.season_end_date(F.col("season")).alias("event_date"),
        F.to_json(F.struct("season")).alias("event_payload"),
    )
    return new_events(events, stored)


def injury_report_rows(rows: DataFrame, day: Column) -> DataFrame:
    """Injury reports from exploded page rows (name, position, return, status, comment)."""
    cell = lambda i: F.get("cells", F.lit(i))
    body = rows.where((F.size("cells") >= 5) & (cell(0) != "") & (F.upper(cell(0)) != "NAME"))
    note = F.nullif(F.concat_ws(" | ", F.nullif(cell(2), F.lit("")), F.nullif(cell(4), F.lit(""))), F.lit(""))
    return body.select(
        cell(0).alias("player_name"), cell(3).alias("status"), day.alias("status_date"), note.alias("note"),
        (F.shiftleft(F.col("table_no").cast("bigint"), 32) + F.col("row_no")).alias("seq"),
    )


def transaction_rows(rows: DataFrame, today: Column) -> DataFrame:
    """(txn_type, txn_date, player_name) from exploded page rows; future dates drop out."""
    body = rows.where(F.size("cells") >= 3)
    text = F.element_at("cells", -1)
    out = body.select(
        event_text.classify_transaction(text).alias("txn_type"),
        dates.short_date(F.get("cells", F.lit(0)), F.year(today)).alias("txn_date"),
        event_text.player_in_sentence(text).alias("player_name"),
    )
    return out.dropna().where(F.col("txn_date") <= today)


def transaction_events(rows: DataFrame, player: DataFrame, stored: DataFrame, since: Column) -> DataFrame:
    recent = rows.where(F.col("txn_date") >= since)
    named = resolve_names(recent, player).where(F.col("player_id").isNotNull())
    events = named.select(
        "player_id", F.col("txn_type").alias("event_type"), F.col("txn_date").cast("timestamp").alias("event_date"),
        F.to_json(F.struct("txn_type")).alias("event_payload"),
    )
    return new_events(events, stored)


def event_refresh(
    daily: dict[str, Callable[[], DataFrame]], weekly: dict[str, Callable[[], DataFrame]], is_monday: bool
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Run each due feed on its own and store its events; one feed's failure, in building or in reading it, is recorded and the rest go on.

    The frames returned are the stored ones, so that nothing can fail in them later.
    """
    done, failed = {}, {}
    for name, build in {**daily, **(weekly if is_monday else {})}.items():
        try:
            done[name] = stage(build(), f"feed-{name}")
        except Exception as error:  # noqa: BLE001 - a broken feed must not stop the others
            failed[name] = str(error)
    return done, failed


def refresh_counts(feeds: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("feed"), F.count(F.lit(1)).alias("written")) for name, df in feeds.items()]
    return reduce(DataFrame.unionByName, parts)


def recent_events(events: DataFrame, player: DataFrame, since: Column, limit: int = 100) -> DataFrame:
    joined = events.where(F.col("event_date") >= since).join(player.select("player_id", F.col("name").alias("player_name")), "player_id")
    return joined.orderBy(F.col("event_date").desc(), F.col("event_id").desc()).limit(limit).select(
        "event_id", "event_date", "player_name", "event_type", "event_payload"
    )


