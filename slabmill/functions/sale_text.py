"""Pasted sale records: cutting page text into records and reading their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabmill.operators.once import compute_once

# --- Fixed values: platforms, listing types and patterns ------------------------
PLATFORMS = (
    "PRISTINE AUCTION",
    "FANATICS WEEKLY",
    "FANATICS",
    "CARD HOBBY",
    "MY SLABS",
    "HERITAGE",
    "GOLDIN",
    "EBAY",
    "ALT",
)
LISTING_TYPES = ("Best Offer", "Auction", "Buy Now", "Fixed Price")
PRICE = r"(?i)\bPrice\s+\$([0-9][0-9,]*(?:\.[0-9]{2})?)\b"
DATE = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},\s+\d{4}\b"
TITLE_YEAR = r"\b(?:19|20)\d{2}(?:-\d{2})?\b"
STARTS = "(?i)^(" + "|".join(PLATFORMS) + ")"
SOURCE = "cardladder_manual"
SEARCH_URL = "https://app.cardladder.com/sales-history?sort=date&direction=desc&q="


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def platform(record: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(record, STARTS, 1), F.lit("")))


def split_records(text: Column) -> Column:
    """Array of records: a platform line closes a record that already has price and date."""
    lines = F.filter(F.transform(F.split(text, r"\R"), squeeze), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        current, done = acc["open"], acc["done"]
        opens, started, headed = line.rlike(STARTS), current != "", current.rlike(STARTS)
        complete = current.rlike(PRICE) & current.rlike(DATE)
        joined = F.when(started, F.concat_ws(" ", current, line)).otherwise(line)
        return (
            F.when(started & opens & ~headed, F.struct(done.alias("done"), line.alias("open")))
            .when(started & opens & complete, F.struct(F.array_append(done, current).alias("done"), line.alias("open")))
            .otherwise(F.struct(done.alias("done"), joined.alias("open")))
        )

    return F.aggregate(
        lines, empty, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
    )


def _sale_suffix(record: Column, price_end: Column, date_start: Column) -> Column:
    between = F.substring(record, price_end + 1, F.greatest(date_start - price_end, F.lit(0)))
    return F.lower(squeeze(F.regexp_replace(between, r"(?i)\bverified\b", " ")))


def _listing_type(suffix: Column, prefix: Column) -> Column:
    """First listing type named after the price, else before it."""
    out = F.lit(None).cast("string")
    for kind in reversed(LISTING_TYPES):
        out = F.when(prefix.contains(kind.upper()), kind).otherwise(out)
    for kind in reversed(LISTING_TYPES):
        out = F.when(suffix.contains(kind.lower()), kind).otherwise(out)
    return out


def _head(record: Column, seller: Column, price_start: Column) -> Column:
    """Text between the platform and the price, without a paid marker."""
    skip = F.length(seller)
    between = F.trim(F.substring(record, skip + 1, F.greatest(price_start - skip, F.lit(0))))
    return F.trim(F.regexp_replace(between, r"(?i)^\(?CONFIRMED PAID\)?\s+", ""))


def _title(head: Column, seller: Column) -> Column:
    """Title without a marketplace seller's leading dash text and leading sale words."""
    at_year = F.regexp_instr(head, F.lit(TITLE_YEAR))
    undashed = F.when(at_year > 0, F.substr(head, at_year)).otherwise(F.regexp_replace(head, r"^[- ]+", ""))
    named = F.when((seller == "EBAY") & head.startswith("-"), undashed).otherwise(head)
    return F.trim(F.regexp_replace(F.trim(named), r"(?i)^(?:(?:BUY NOW|AUCTION|FIXED PRICE|BEST OFFER)\s*)+", ""))


def with_record_fields(df: DataFrame, record: Column, name: str = "s") -> DataFrame:
    """Add a struct of one record's fields, NULL when platform, price or date is missing."""
    df = compute_once(df, "_x", squeeze(record).alias("text"))
    text = F.col("_x.text")
    df = compute_once(
        df,
        "_r",
        platform(text).alias("seller"),
        F.regexp_substr(text, F.lit(PRICE)).alias("price_text"),
        (F.regexp_instr(text, F.lit(PRICE)) - 1).alias("price_start"),
        F.try_element_at(F.regexp_extract_all(text, F.lit(f"({DATE})"), F.lit(1)), F.lit(-1)).alias("last"),
        F.length(F.element_at(F.split(text, DATE), -1)).alias("after"),
    )
    r = lambda field: F.col(f"_r.{field}")
    price_end = r("price_start") + F.length(r("price_text"))
    date_start = F.length(text) - r("after") - F.length(r("last"))
    df = compute_once(
        df,
        "_h",
        _head(text, r("seller"), r("price_start")).alias("head"),
        _sale_suffix(text, price_end, date_start).alias("suffix"),
        F.upper(F.substring(text, F.lit(1), price_end)).alias("prefix"),
    )
    df = compute_once(
        df,
        "_t",
        _title(F.col("_h.head"), r("seller")).alias("title"),
        _listing_type(F.col("_h.suffix"), F.col("_h.prefix")).alias("kind"),
    )
    title, kind = F.col("_t.title"), F.col("_t.kind")
    warnings = F.filter(
        F.array(F.when(title == "", "missing_title"), F.when(kind.isNull(), "missing_listing_type")), lambda w: w.isNotNull()
    )
    fields = F.struct(
        r("seller").alias("platform"),
        title.alias("raw_title"),
        F.replace(F.regexp_extract(r("price_text"), PRICE, 1), F.lit(","), F.lit("")).try_cast("decimal(14,2)").alias("price_usd"),
        F.try_to_timestamp(squeeze(r("last")), F.lit("MMM d, yyyy")).alias("sold_at"),
        kind.alias("listing_type"),
        (text.rlike(r"(?i)\bverified\b") | F.upper(text).contains("CONFIRMED PAID")).alias("verified"),
        text.alias("raw_text"),
        warnings.alias("warnings"),
    )
    whole = r("seller").isNotNull() & r("price_text").isNotNull() & r("last").isNotNull()
    return df.withColumn(name, F.when(whole, fields)).drop("_x", "_r", "_h", "_t")


def quick_record(seller: Column, title: Column, price: Column, sold: Column, kind: Column, verified: Column) -> Column:
    """Record text of one typed-in sale."""
    return F.concat_ws(
        " ",
        F.upper(F.trim(seller)),
        F.trim(title),
        F.concat(F.lit("Price $"), F.format_number(price.cast("decimal(14,2)"), 2)),
        F.when(verified, "verified"),
        kind,
        F.date_format(sold, "MMM d, yyyy"),
    )


def stable_external_id(sale_id: Column, seller, title, sold, price, kind, text) -> Column:
    payload = F.concat_ws(
        "|",
        F.upper(seller),
        F.lower(title),
        F.date_format(sold, "yyyy-MM-dd"),
        price.cast("decimal(14,2)").cast("string"),
        F.lower(F.coalesce(kind, F.lit(""))),
        F.lower(text),
    )
    return F.coalesce(F.nullif(F.trim(sale_id), F.lit("")), F.concat(F.lit("clm-"), F.substring(F.sha2(payload, 256), 1, 32)))


def sale_id_from_url(url: Column) -> Column:
    """Sale id from a query parameter or from known host and path shapes."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    param = F.nullif(F.trim(F.try_url_decode(F.regexp_extract(full, r"[?&]saleId=([^&#]*)", 1))), F.lit(""))
    host = F.lower(F.regexp_extract(full, r"://([^/?#]*)", 1))
    path = F.regexp_extract(full, r"://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    one, two, three = (F.get(parts, F.lit(i)) for i in range(3))
    return (
        F.when(param.isNotNull(), param)
        .when(host.endswith("ebay.com") & (one == "itm") & two.isNotNull(), F.concat(F.lit("ebay-"), two))
        .when(host.endswith("fanaticscollect.com") & (one == "weekly") & two.isNotNull(), F.concat(F.lit("fanatics-weekly-"), two))
        .when(host.endswith("fanaticscollect.com") & (one == "buy-now") & two.isNotNull(), F.concat(F.lit("fanatics-buy-now-"), two))
        .when(host.endswith("alt.xyz") & (one == "browse") & (two == "sold") & three.isNotNull(), F.concat(F.lit("alt-sold-"), three))
        .when(host.endswith("goldin.co") & (one == "item") & two.isNotNull(), F.concat(F.lit("goldin-item-"), two))
        .when(host.endswith("pristineauction.com") & one.isNotNull(), F.concat(F.lit("pristineauction-"), one))
    )


def search_url(query: Column) -> Column:
    encoded = F.url_encode(query)
    for text, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(text), F.lit(code))
    return F.concat(F.lit(SEARCH_URL), encoded)
