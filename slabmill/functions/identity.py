"""Canonical card identity from a title and its search query, as native columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabmill.functions import titles
from slabmill.functions.cards import first_match
from slabmill.functions.names import slugify
from slabmill.operators.once import compute_once

# --- Fixed values: identity patterns and phrase tables ----------------------------
CARD_NUMBER = r"(?i)#\s*(?:NO\.)?\s*([A-Z0-9.-]+)"
QUERY_TAIL = r"(?s)\b(?:Bowman Chrome|Topps Chrome|Prizm|Select|Mosaic|PSA|BGS|SGC)\b.*$"
MANUFACTURERS = (
    ("panini", "Panini"),
    ("topps", "Topps"),
    ("bowman", "Bowman"),
    ("upper deck", "Upper Deck"),
    ("fleer", "Fleer"),
)
SETS = (
    ("bowman chrome", "Bowman Chrome"),
    ("topps chrome", "Topps Chrome"),
    ("donruss optic", "Donruss Optic"),
    ("national treasures", "National Treasures"),
    ("select", "Select"),
    ("mosaic", "Mosaic"),
    ("obsidian", "Obsidian"),
    ("hoops premium stock", "Hoops Premium Stock"),
    ("hoops", "Hoops"),
    ("donruss", "Donruss"),
    ("chronicles", "Chronicles"),
    ("prizm black", "Prizm Black"),
    ("prizm", "Prizm"),
)
SUBSETS = (
    "Storm Chasers",
    "Prizmania",
    "Prizm Break",
    "Mindset",
    "Fearless",
    "Bank Shot",
    "Thunder Road",
    "Net Marvels",
    "My House",
    "Epic Performers",
    "Widescreen",
    "Select Numbers",
    "Rainmakers",
    "Variation",
)
PARALLELS = (
    "Blue and Silver Prizm",
    "Green White Purple Prizm",
    "Fast Break Prizm",
    "Fast Break",
    "Pink Swirl Prizm",
    "Blue Shimmer Prizm",
    "Silver Prizm",
    "Silver",
    "Gold Prizm",
    "Gold",
    "Black",
    "Red Cracked Ice Prizm",
    "Red Cracked Ice",
    "Red Ice",
    "Blue Disco Prizm",
    "Green Prizm",
    "Green",
    "Purple Die-Cut",
    "Holo Prizm",
    "Holo",
    "Mojo",
    "Mosaic Silver Prizm",
    "Mosaic",
    "Cosmic Prizm",
    "Fractal",
)
KNOWN_PLAYERS = (
    "Stephen Curry",
    "Giannis Antetokounmpo",
    "Nikola Jokic",
    "LeBron James",
    "Kevin Durant",
    "Kobe Bryant",
    "Michael Jordan",
    "Luka Doncic",
    "Victor Wembanyama",
    "Anthony Edwards",
    "Shai Gilgeous-Alexander",
    "Cooper Flagg",
)
FIELD_POINTS = {
    "player_name": 0.20,
    "manufacturer": 0.12,
    "card_year": 0.18,
    "set_name": 0.20,
    "card_number": 0.15,
    "slab_grader": 0.07,
    "slab_grade": 0.08,
}
REVIEW_BELOW = 0.850


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(title, F.lit("≈"), F.lit(" ")), r"\s+", " "))


def player_name(low: Column, query: Column) -> Column:
    """Leading words of the search query, else the first known name in the lower-cased title."""
    searched = F.nullif(F.trim(F.regexp_replace(query, QUERY_TAIL, "")), F.lit(""))
    known = first_match(low, [(n.lower(), n) for n in KNOWN_PLAYERS], F.lit(None))
    return F.coalesce(searched, known)


def card_number(title: Column) -> Column:
    value = F.upper(F.trim(titles.capture(title, CARD_NUMBER), F.lit(".")))
    return F.when(~value.isin("NO", ""), value)


def parallel_hits(low: Column) -> Column:
    """Bit ``k`` is set where phrase ``k`` of ``PARALLELS`` stands in the title as whole words."""
    hits = [F.when(low.contains(p.lower()) & low.rlike(rf"(?<![a-z0-9]){p.lower()}(?![a-z0-9])"), 1 << k).otherwise(0) for k, p in enumerate(PARALLELS)]
    return reduce(lambda a, b: a.bitwiseOR(b), hits)


def _any_of(hits: Column, phrases: Iterable[str]) -> Column:
    return hits.bitwiseAND(sum(1 << PARALLELS.index(p) for p in phrases)) != 0


def parallel_words(hits: Column, first: int, end: int) -> Column:
    """Phrases ``first`` to ``end`` that are set and stand in no earlier one that is set, joined; empty without any.

    Which phrase absorbs which is known beforehand, so bits are tested and no array is folded: lambdas are not compiled.
    """
    words = []
    for k, p in list(enumerate(PARALLELS))[first:end]:
        within = [e for e in PARALLELS[:k] if p.lower() in e.lower()]
        words.append(F.when(_any_of(hits, [p]) & ~_any_of(hits, within) if within else _any_of(hits, [p]), p))
    return F.concat_ws(" / ", *words)


def parallel(low: Column, set_name: Column, hits: Column, words: list[Column]) -> Column:
    """All parallel phrases of a title, longer ones absorbing the words they contain."""
    bare = (
        low.contains("prizm")
        & ~F.coalesce(set_name.isin("Prizm", "Prizm Black"), F.lit(False))
        & ~_any_of(hits, [p for p in PARALLELS if "Prizm" in p])
    )
    joined = F.concat_ws(" / ", *[F.when(w != "", w) for w in words], F.when(bare, "Prizm"))
    blue_silver = low.contains("prizm blue and silver") | low.contains("blue and silver prizm")
    return F.when(blue_silver, "Blue and Silver Prizm").otherwise(F.coalesce(F.nullif(joined, F.lit("")), F.lit("Base")))


def canonical_key(c: dict[str, Column]) -> Column:
    """Slugged identity fields joined by bars, missing ones left out."""
    pieces = [
        c["player_name"],
        c["manufacturer"],
        c["card_year"].cast("string"),
        c["set_name"],
        c["subset"],
        F.concat(F.lit("#"), c["card_number"]),
        F.coalesce(c["parallel"], F.lit("Base")),
        F.concat(F.lit("/"), c["print_run"].cast("string")),
        F.when(c["is_rookie"], "rookie"),
        F.when(c["has_auto"], "auto"),
        F.when(c["has_patch"], "patch"),
    ]
    return F.concat_ws("|", *[slugify(p) for p in pieces])


IDENTITY_FIELDS = (
    "player_name", "manufacturer", "card_year", "set_name", "subset", "card_number", "parallel", "print_run",
    "is_rookie", "has_auto", "has_patch", "slab_grader", "slab_grade",
)


def with_identity(df: DataFrame, title: Column, query: Column, name: str = "i") -> DataFrame:
    """Add a struct with the canonical key, every identity field, confidence and evidence."""
    # Many short steps: a step is one method, and the JVM leaves methods of over 8,000 bytes of code uncompiled.
    df = compute_once(df, "_s", normalize_title(title).alias("text"), query.alias("query"))
    df = compute_once(df, "_low", F.lower("_s.text").alias("v"))
    text, low = F.col("_s.text"), F.col("_low.v")
    df = compute_once(df, "_h", parallel_hits(low).alias("hits"))
    df = compute_once(
        df,
        "_f",
        player_name(low, F.col("_s.query")).alias("player_name"),
        first_match(low, SETS, F.lit(None)).alias("set_name"),
        first_match(low, MANUFACTURERS, F.lit(None)).alias("maker"),
        first_match(low, [(s.lower(), s) for s in SUBSETS], F.lit(None)).alias("subset"),
    )
    f = lambda field: F.col(f"_f.{field}")
    by_set = F.when(f("set_name") == "Bowman Chrome", "Bowman").otherwise(titles.implied_manufacturer(f("set_name")))
    hits, half = F.col("_h.hits"), len(PARALLELS) // 2
    df = compute_once(df, "_w", parallel_words(hits, 0, half).alias("first"))
    df = compute_once(df, "_v", parallel_words(hits, half, len(PARALLELS)).alias("rest"))
    df = compute_once(
        df,
        "_i",
        f("player_name").alias("player_name"),
        F.coalesce(f("maker"), by_set).alias("manufacturer"),
        titles.year(text).alias("card_year"),
        f("set_name").alias("set_name"),
        f("subset").alias("subset"),
        card_number(text).alias("card_number"),
        parallel(low, f("set_name"), hits, [F.col("_w.first"), F.col("_v.rest")]).alias("parallel"),
        titles.print_run(text).alias("print_run"),
        low.rlike(r"\b(rookie|rc)\b").alias("is_rookie"),
        low.rlike(r"\b(auto|autograph)\b").alias("has_auto"),
        (low.contains("patch") | low.contains("rpa")).alias("has_patch"),
        titles.grader(text).alias("slab_grader"),
        titles.grade(text).alias("slab_grade"),
    )
    c = {field: F.col(f"_i.{field}") for field in IDENTITY_FIELDS}
    df = compute_once(df, "_k", canonical_key(c).alias("key"))  # filters on the key don't make it again
    score = sum((F.when(c[f].isNotNull(), F.lit(p)).otherwise(0.0) for f, p in FIELD_POINTS.items()), F.lit(0.0))
    confidence = F.round(F.least(score, F.lit(1.0)), 3)
    evidence = F.to_json(
        F.struct(F.col("_s.text").alias("title"), F.col("_s.query").alias("search_query"), F.lit("identity_regex_v1").alias("source"))
    )
    out = F.struct(
        F.col("_k.key").alias("canonical_key"),
        *[c[field].alias(field) for field in IDENTITY_FIELDS],
        confidence.alias("confidence"),
        (confidence < REVIEW_BELOW).alias("needs_review"),
        evidence.alias("evidence_json"),
    )
    return df.withColumn(name, out).drop("_s", "_low", "_h", "_f", "_w", "_v", "_i", "_k")
