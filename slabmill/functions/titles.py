"""Listing-title fields as native columns (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabmill.functions.cards import first_match
from slabmill.operators.once import compute_once

# --- Fixed values: patterns and phrase tables (order matters, specific first) ----
YEAR = r"\b((?:19|20)\d{2})(?:[-/](\d{2}))?\b"
CARD_NUMBER = r"#\s*([A-Z0-9-]+)"
CERT = r"(?i)\b(?:cert(?:ification)?|cert\s*#)\s*([0-9]{6,})\b"
GRADE = r"(?i)\b(PSA|BGS|SGC|CGC)\s*(10|9(?:\.5)?|8(?:\.5)?|[1-9](?:\.5)?)\b"
PRINT_RUN = r"/(\d{1,4})\b"
MANUFACTURERS = (("panini", "Panini"), ("topps", "Topps"), ("upper deck", "Upper Deck"), ("fleer", "Fleer"))
SETS = (
    ("national treasures", "National Treasures"),
    ("flawless", "Flawless"),
    ("immaculate", "Immaculate"),
    ("topps chrome", "Topps Chrome"),
    ("donruss optic", "Donruss Optic"),
    ("optic", "Donruss Optic"),
    ("select", "Select"),
    ("prizm", "Prizm"),
    ("mosaic", "Mosaic"),
    ("contenders", "Contenders"),
    ("hoops", "Hoops"),
    ("donruss", "Donruss"),
)
SET_MANUFACTURER = {
    "Prizm": "Panini",
    "Select": "Panini",
    "Mosaic": "Panini",
    "National Treasures": "Panini",
    "Flawless": "Panini",
    "Immaculate": "Panini",
    "Donruss Optic": "Panini",
    "Donruss": "Panini",
    "Contenders": "Panini",
    "Hoops": "Panini",
    "Topps Chrome": "Topps",
}
PARALLELS = (
    ("black 1/1", "Black 1/1"),
    ("gold /10", "Gold /10"),
    ("gold vinyl", "Gold Vinyl"),
    ("red ice", "Red Ice"),
    ("silver", "Silver"),
    ("blue ice", "Blue Ice"),
    ("blue wave", "Blue Wave"),
    ("blue", "Blue"),
    ("red wave", "Red Wave"),
    ("red", "Red"),
    ("green", "Green"),
    ("orange", "Orange"),
    ("purple", "Purple"),
    ("pink", "Pink"),
    ("refractor", "Refractor"),
    ("x-fractor", "X-Fractor"),
    ("xfractor", "X-Fractor"),
    ("holo", "Holo"),
)


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group or NULL."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def year(title: Column) -> Column:
    return capture(title, YEAR).cast("int")


def grader(title: Column) -> Column:
    return F.upper(capture(title, GRADE))


def grade(title: Column) -> Column:
    return capture(title, GRADE, 2).cast("double")


def print_run(title: Column) -> Column:
    return capture(title, PRINT_RUN).cast("int")


def implied_manufacturer(set_name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SET_MANUFACTURER.items() for x in kv])
    return F.try_element_at(table, set_name)


def with_title_fields(df: DataFrame, title: str = "raw_title", name: str = "p") -> DataFrame:
    """Add a struct with every title field, the confidence and the method."""
    text, low = F.col(title), F.col("_low.v")
    df = compute_once(
        compute_once(df, "_low", F.lower(text).alias("v")),
        "_t",
        year(text).alias("card_year"),
        first_match(low, MANUFACTURERS, F.lit(None)).alias("maker"),
        first_match(low, SETS, F.lit(None)).alias("set_name"),
        first_match(low, PARALLELS, F.lit(None)).alias("parallel"),
        capture(text, PRINT_RUN).alias("run"),
        capture(text, CARD_NUMBER).alias("card_number"),
        grader(text).alias("slab_grader"),
        grade(text).alias("slab_grade"),
        low.alias("low"),
    )
    t = {f: F.col(f"_t.{f}") for f in ("card_year", "set_name", "card_number", "slab_grader", "slab_grade", "low")}
    maker = F.coalesce(F.col("_t.maker"), implied_manufacturer(t["set_name"]))
    core = t["card_year"].isNotNull() & maker.isNotNull() & t["set_name"].isNotNull() & t["card_number"].isNotNull()
    graded = t["slab_grader"].isNotNull() & t["slab_grade"].isNotNull()
    points = sum(
        (
            F.when(c.isNotNull(), F.lit(p)).otherwise(0.0)
            for c, p in ((t["card_year"], 0.25), (maker, 0.15), (t["set_name"], 0.25), (t["card_number"], 0.15))
        ),
        F.lit(0.0),
    )
    raw_card = ~graded & core
    score = F.when(graded, points + 0.20).when(raw_card, F.greatest(points, F.lit(0.85))).otherwise(points)
    low = t["low"]
    fields = F.struct(
        t["card_year"].alias("card_year"),
        maker.alias("manufacturer"),
        t["set_name"].alias("set_name"),
        F.coalesce("_t.parallel", F.concat(F.lit("/"), F.col("_t.run")), F.lit("Base")).alias("parallel"),
        t["card_number"].alias("card_number"),
        t["slab_grader"].alias("slab_grader"),
        t["slab_grade"].alias("slab_grade"),
        capture(text, CERT).alias("cert_number"),
        low.rlike(r"\b(rookie|rc)\b").alias("is_rookie"),
        low.rlike(r"\b(auto(?:graph)?)\b").alias("has_auto"),
        (low.contains("patch") | low.contains("rpa")).alias("has_patch"),
        (low.contains("1/1") | low.contains("1 of 1") | low.contains("one of one")).alias("is_one_of_one"),
        F.round(F.least(score, F.lit(1.0)), 3).alias("confidence"),
        F.when(raw_card, "regex_raw").otherwise("regex").alias("method"),
    )
    return df.withColumn(name, fields).drop("_t", "_low")
