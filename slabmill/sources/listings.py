"""Landed listing feeds: marketplace JSON, auction CSV, pasted sale text, captured links, populations, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabmill.functions import sale_text
from slabmill.functions.dates import day_start

LISTING = T.StructType(
    [
        T.StructField("itemId", T.StringType()),
        T.StructField("legacyItemId", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("price", T.StructType([T.StructField("value", T.StringType()), T.StructField("currency", T.StringType())])),
        T.StructField("itemCreationDate", T.StringType()),
    ]
)
AUCTION_HOUSES = ("goldin", "heritage", "fanatics_collect")
RAW_COLUMNS = ["source", "raw_title", "raw_price", "raw_currency", "sold_at", "external_id", "raw_json"]


def listings_from_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw rows from JSON text, one listing per row; the full text is kept."""
    x = lines.select(F.col(column).alias("raw_json"), F.from_json(column, LISTING).alias("j"))
    item = F.coalesce(F.nullif("j.itemId", F.lit("")), F.nullif("j.legacyItemId", F.lit("")))
    return x.where(item.isNotNull()).select(
        F.lit("ebay_active").alias("source"),
        F.coalesce("j.title", F.lit("")).alias("raw_title"),
        F.col("j.price.value").try_cast("decimal(14,2)").alias("raw_price"),
        F.coalesce("j.price.currency", F.lit("USD")).alias("raw_currency"),
        F.try_to_timestamp("j.itemCreationDate").alias("sold_at"),
        item.alias("external_id"),
        "raw_json",
    )


def read_listing_json(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited listing JSON."""
    return listings_from_text(spark.read.text(path))


def auction_rows(frame: DataFrame, house: str) -> DataFrame:
    """Raw rows from an auction export with any header case."""
    if house not in AUCTION_HOUSES:
        raise ValueError(f"unknown house {house!r}; expected one of {AUCTION_HOUSES}")
    df = frame.toDF(*[c.lower() for c in frame.columns])
    have = set(df.columns)
    sold = F.to_timestamp(F.col("sold_at"))
    price = F.col("price").cast("string")
    fallback = F.concat_ws(":", F.date_format(sold, "yyyy-MM-dd'T'HH:mm:ssXXX"), price)
    lot = F.coalesce(F.col("lot_id").cast("string"), fallback) if "lot_id" in have else fallback
    return df.select(
        F.lit(house).alias("source"),
        (F.coalesce(F.col("lot_title"), F.lit("")) if "lot_title" in have else F.lit("")).alias("raw_title"),
        price.try_cast("decimal(14,2)").alias("raw_price"),
        (F.coalesce(F.col("currency"), F.lit("USD")) if "currency" in have else F.lit("USD")).alias("raw_currency"),
        sold.alias("sold_at"),
        F.concat(F.lit(f"{house}:"), lot).alias("external_id"),
        F.to_json(F.struct(*df.columns)).alias("raw_json"),
    )


def read_auction_csv(spark: SparkSession, path: str, house: str) -> DataFrame:
    return auction_rows(spark.read.option("header", True).csv(path), house)


def sales_from_text(pages: DataFrame, text: str, query: Column) -> DataFrame:
    """Sale records of pasted pages."""
    records = pages.select(query.alias("search_query"), F.explode(sale_text.split_records(F.col(text))).alias("r"))
    sales = sale_text.with_record_fields(records, F.col("r")).where(F.col("s").isNotNull())
    return sales.select("s.*", "search_query", F.lit(None).cast("string").alias("external_sale_id"))


def read_sale_text(spark: SparkSession, path: str, query: str) -> DataFrame:
    return sales_from_text(spark.read.text(path, wholetext=True), "value", F.lit(query))


def sales_from_links(links: DataFrame, query: Column) -> DataFrame:
    """Sales from captured link descriptions; identical (description, sale id) pairs collapse."""
    seen = links.select(F.trim("description").alias("description"), F.trim("value").alias("url"), query.alias("search_query"))
    seen = seen.where(F.contains("description", F.lit(" Price $"))).withColumn("external_sale_id", sale_text.sale_id_from_url(F.col("url")))
    seen = seen.dropDuplicates(["search_query", "description", "external_sale_id"])
    first = F.get(sale_text.split_records(F.col("description")), F.lit(0))
    sales = sale_text.with_record_fields(seen, first).where(F.col("s").isNotNull())
    return sales.select("s.*", "search_query", "external_sale_id")


def read_sale_links(spark: SparkSession, path: str, query: str) -> DataFrame:
    schema = "description string, value string"
    return sales_from_links(spark.read.schema(schema).option("multiLine", True).json(path), F.lit(query))


def explode_population(payloads: DataFrame, column: str, now: Column) -> DataFrame:
    """One row per grade of each card's population payload; rows without both values drop out."""
    grades = F.from_json(column, "struct<PSAPopulation:array<map<string,string>>>")["PSAPopulation"]
    bare = F.from_json(column, "array<map<string,string>>")
    items = payloads.select("card_id", F.explode(F.coalesce(grades, bare)).alias("e"))
    pick = lambda a, b: F.coalesce(F.try_element_at("e", F.lit(a)), F.try_element_at("e", F.lit(b)))
    return items.select(
        day_start(now).alias("snapshot_date"),
        "card_id",
        F.lit("PSA").alias("grader"),
        pick("Grade", "grade").try_cast("double").alias("grade"),
        pick("Population", "pop").try_cast("bigint").alias("pop_count"),
    ).where(F.col("grade").isNotNull() & F.col("pop_count").isNotNull())


def resolve_seed_cards(seed: DataFrame, player: DataFrame) -> DataFrame:
    """Seed cards with ``player`` names resolved to ids; unknown names drop out."""
    ids = player.select(F.col("name").alias("player"), "player_id")
    return seed.join(ids, "player").drop("player")


def load_reference_table(spark: SparkSession, path: str, schema: str, player: DataFrame | None = None) -> DataFrame:
    """Seed rows from JSON lines or CSV; pass ``player`` to resolve card seeds."""
    reader = spark.read.schema(schema)
    seed = reader.option("header", True).csv(path) if path.endswith(".csv") else reader.json(path)
    return seed if player is None else resolve_seed_cards(seed, player)
