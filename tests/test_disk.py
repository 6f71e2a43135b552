"""What queries write: bytes of results and of shuffles, beside the rows themselves."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from slabmill.functions import sale_text
from slabmill.functions.identity import IDENTITY_FIELDS
from slabmill.operators import asof
from slabmill.operators.asof import first_by
from slabmill.plans import events, parsing
from slabmill.sources.warehouse import Warehouse


def stored_bytes(df, folder) -> int:
    df.write.parquet(str(folder))
    return sum(f.stat().st_size for f in Path(folder).glob("*.parquet"))


def test_fan_out_takes_few_bytes_a_row(spark, tmp_path):
    games = spark.range(1200).select(F.format_string("004%09d", F.col("id") * 37).alias("game_id"), F.concat(F.lit("T"), F.col("id") % 2).alias("winner_team"))
    roster = spark.range(3000).select(F.col("id").cast("int").alias("player_id"), F.concat(F.lit("T"), F.col("id") % 3).alias("winner_team"))
    out = events.on_roster(games, roster, "game_id", "player_id")
    assert stored_bytes(out, tmp_path / "out") < 0.5 * 1200 * 1000
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1200 * 1000


def test_fan_out_keeps_repeated_and_null_rows(spark):
    games = [("a", "T"), ("a", "T"), (None, "T"), ("b", None), ("c", "U"), *((f"g{i}", "T") for i in range(2 * events.RUN + 1))]
    roster = [(1, "T"), (1, "T"), (2, "T"), (None, "T"), (3, None), (4, "V")]
    out = events.on_roster(spark.createDataFrame(games, "game_id string, team string"), spark.createDataFrame(roster, "player_id int, team string"), "game_id", "player_id")
    assert Counter(map(tuple, out.collect())) == Counter((g, p) for g, a in games for p, b in roster if a == b and a)


def test_inserted_rows_are_exchanged_once(spark, tmp_path, monkeypatch):
    rows = spark.range(2000).select(
        F.concat(F.lit("id-"), F.col("id") % 1500).alias("external_id"), F.lit("ebay").alias("source"), F.concat(F.lit("title "), F.col("id")).alias("raw_title")
    )
    wh = Warehouse(spark, str(tmp_path))

    def exchanged_again(*_):
        raise AssertionError("rows that lie by their key need no second exchange")

    monkeypatch.setattr(type(rows), "repartition", exchanged_again)
    assert wh.insert_if_absent(rows, "tx_raw") == 1500 and wh.insert_if_absent(rows, "tx_raw") == 0
    assert {r["external_id"]: r["raw_title"] for r in wh.read_table("tx_raw").where("external_id in ('id-7', 'id-1499')").collect()} == {"id-7": "title 1507", "id-1499": "title 1499"}


def test_the_first_row_of_a_key_carries_a_column_once(spark):
    df = spark.createDataFrame([(1, "b", None), (1, "a", "y"), (1, "a", "x"), (2, None, "z"), (2, "c", "q")], "k int, a string, b string")
    first = first_by(df, ["k"], ["a", "b"])
    assert sorted(map(tuple, first.collect())) == [(1, "a", "x"), (2, None, "z")]
    assert "min_by" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_reviewed_rows_meet_their_actions_in_one_join(spark):
    fields = {f: F.lit(None).cast("boolean" if f in ("is_rookie", "has_auto", "has_patch") else "string") for f in IDENTITY_FIELDS}
    candidates = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False), (None, True), ("a", True)], "raw_id string, needs_review boolean").select(
        "raw_id", F.lit("key").alias("canonical_key"), *[v.alias(f) for f, v in fields.items()], F.lit(0.5).alias("confidence"), "needs_review", F.lit("{}").alias("evidence_json")
    )
    rows = [("a", 1, "reject", "n", None), ("a", 2, "approve", None, None), ("b", 1, "update", None, "Ann"), ("c", 1, None, None, None), (None, 1, "approve", None, None)]
    actions = spark.createDataFrame(rows, "raw_id string, seq int, action string, note string, new_player_name string")
    out = parsing.review_actions(candidates, actions)
    got = sorted(((r["raw_id"], r["player_name"], r["confidence"], r["needs_review"]) for r in out.collect()), key=repr)
    assert got == sorted([("a", None, 1.0, False)] * 2 + [("b", "Ann", 1.0, False), ("c", None, 0.5, None), ("d", None, 0.5, False), (None, None, 0.5, True)], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan


def test_imported_rows_are_not_joined_after_they_are_stored(spark, monkeypatch):
    kind = "platform string, raw_title string, price_usd decimal(14,2), sold_at timestamp, listing_type string, verified boolean, raw_text string, warnings array<string>, search_query string, external_sale_id string"
    sales = spark.createDataFrame([("EBAY", "2018 Prizm #1", None, None, None, True, f"t{i}", [], "q", f"s{i}") for i in (1, 2, 2, 3)], kind)
    stored = spark.createDataFrame([("s1", sale_text.SOURCE), ("s1", sale_text.SOURCE), ("s2", "other"), (None, sale_text.SOURCE)], "external_id string, source string")
    card = spark.createDataFrame([], "card_id long, card_year int, manufacturer string, set_name string, card_number string, parallel string")
    plans, kept = [], parsing.stage
    monkeypatch.setattr(parsing, "stage", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, label))
    raw, _, counts = parsing.import_sales(sales, stored, card)
    assert sorted(r["external_id"] for r in raw.collect()) == ["s2", "s3"] and raw.columns[0] == "external_id" and "_known" not in raw.columns
    assert counts.first()["inserted_raw"] == 2 and counts.first()["skipped_duplicates"] == 2
    assert len(plans) == 2 and "Join" in plans[0] and "Join" not in plans[1]


def test_borders_are_found_without_an_exchange_of_rows(spark, monkeypatch):
    gathered, seen = asof.gathered, []
    monkeypatch.setattr(asof, "gathered", lambda df: seen.append(df) or gathered(df))
    df = spark.range(4000).selectExpr("cast(null as string) k", "id t").union(spark.range(500).selectExpr("cast(id % 3 as string) k", "id t"))
    out = asof.next_row(df, ["k"], ["t"], {"n": "t"})
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and text.count("RepartitionBy") == 1
    want = {(None, i): i + 1 if i < 3999 else None for i in range(4000)} | {(str(i % 3), i): i + 3 if i + 3 < 500 else None for i in range(500)}
    assert {(r["k"], r["t"]): r["n"] for r in out.collect()} == want
