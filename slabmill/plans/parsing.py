"""Raw listings to clean sales, identity candidates, reviews and imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabmill.functions import sale_text
from slabmill.functions.identity import IDENTITY_FIELDS, canonical_key, with_identity
from slabmill.functions.titles import with_title_fields
from slabmill.operators.asof import first_by, latest_by
from slabmill.session import stage

CARD_KEY = ["card_year", "manufacturer", "set_name", "card_number", "parallel"]
SOLD_SOURCES = ("ebay",)
MIN_CONFIDENCE = 0.5


def pending_raw(raw: DataFrame, clean: DataFrame, failures: DataFrame, sources: Sequence[str] = SOLD_SOURCES) -> DataFrame:
    """Raw rows of the sold sources that are neither cleaned nor failed."""
    return (
        raw.where(F.col("source").isin(*sources))
        .join(clean.select("raw_id"), "raw_id", "left_anti")
        .join(failures.select("raw_id"), "raw_id", "left_anti")
    )


def confidence_gate(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows carry a reason."""
    ok = (F.col("p.confidence") >= MIN_CONFIDENCE) & F.col("raw_price").isNotNull()
    reason = F.concat(F.lit("low confidence "), F.format_number(F.col("p.confidence"), 3))
    bad = parsed.where(~ok).select("raw_id", reason.alias("reason"))
    return parsed.where(ok), bad


def resolve_card(parsed: DataFrame, card: DataFrame) -> DataFrame:
    """Add card_id by the natural key; rows missing a core field skip the join and stay NULL."""
    keyed = first_by(card.select("card_id", *CARD_KEY), CARD_KEY, ["card_id"])
    full = parsed.select("*", *[F.col(f"p.{k}").alias(k) for k in CARD_KEY])
    core = (
        F.col("card_year").isNotNull() & F.col("manufacturer").isNotNull() & F.col("set_name").isNotNull() & F.col("card_number").isNotNull()
    )
    hit = full.where(core).join(keyed, CARD_KEY, "left").drop(*CARD_KEY)
    miss = full.where(~core).drop(*CARD_KEY).withColumn("card_id", F.lit(None).cast(keyed.schema["card_id"].dataType))
    return hit.unionByName(miss)


def clean_rows(good: DataFrame, card: DataFrame, method_prefix: str = "") -> DataFrame:
    resolved = resolve_card(good, card)
    return resolved.select(
        "raw_id",
        "card_id",
        F.col("p.slab_grader").alias("slab_grader"),
        F.col("p.slab_grade").alias("slab_grade"),
        F.col("p.cert_number").alias("cert_number"),
        F.col("raw_price").cast("double").alias("price_usd"),
        "sold_at",
        F.col("p.confidence").alias("parser_confidence"),
        F.substring(F.concat(F.lit(method_prefix), F.col("p.method")), 1, 16).alias("parser_method"),
    )


def parse_pending(
    raw: DataFrame, clean: DataFrame, failures: DataFrame, card: DataFrame, sources: Sequence[str] = SOLD_SOURCES
) -> tuple[DataFrame, DataFrame]:
    """(new clean rows, new failures) for everything pending."""
    good, bad = confidence_gate(with_title_fields(pending_raw(raw, clean, failures, sources)))
    return clean_rows(good, card), bad


def identity_pending(raw: DataFrame, existing: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    out = raw if source is None else raw.where(F.col("source") == source)
    out = out.join(existing.select("raw_id"), "raw_id", "left_anti")
    return out if limit is None else out.orderBy("raw_id").limit(limit)


def search_query(raw_json: Column) -> Column:
    """Search basket of a raw row; broken or missing JSON gives 'unknown'."""
    return F.coalesce(F.nullif(F.get_json_object(raw_json, "$.search_query"), F.lit("")), F.lit("unknown"))


def materialize_identities(raw: DataFrame, existing: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Identity candidates of rows not yet identified; rows without any identity are skipped."""
    query = F.nullif(F.get_json_object("raw_json", "$.search_query"), F.lit(""))
    pending = identity_pending(raw, existing, source, limit)
    rows = with_identity(pending, F.col("raw_title"), query)
    return rows.select("raw_id", "i.*").where(F.col("canonical_key") != "")


def identity_counts(processed: DataFrame, candidates: DataFrame) -> DataFrame:
    done = candidates.agg(F.count(F.lit(1)).alias("inserted"))
    inserted = done.scalar()
    return processed.agg(F.count(F.lit(1)).alias("processed")).select(
        "processed", inserted.alias("inserted"), (F.col("processed") - inserted).alias("skipped")
    )


def merge_json(document: Column, updates: dict[str, Column]) -> Column:
    """JSON object with keys added or replaced; NULL values are left out."""
    old = F.coalesce(F.from_json(document, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~k.isin(*updates))
    new = F.create_map(*[x for k, v in updates.items() for x in (F.lit(k), v)])
    return F.to_json(F.map_filter(F.map_concat(kept, new), lambda k, v: v.isNotNull()))


def review_actions(candidates: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply a batch of reviewer rows: action approve, update or reject (newest per raw_id wins).

    ``actions`` has raw_id, seq, action, note and any editable identity fields
    prefixed ``new_``; NULL leaves a field as it is.
    """
    last = latest_by(actions, ["raw_id"], ["seq"])
    edits = [f for f in IDENTITY_FIELDS if f"new_{f}" in actions.columns]
    # Reviewers touch few rows; only those carry the key and JSON work, and all are exchanged once.
    joined = candidates.join(last.withColumn("_touched", F.lit(True)), "raw_id", "left")
    act, touched = F.col("action"), F.col("_touched")
    update = act == "update"
    fields = {
        f: F.when(update, F.coalesce(F.nullif(F.col(f"new_{f}"), F.lit("")) if f in TEXT_FIELDS else F.col(f"new_{f}"), F.col(f))).otherwise(F.col(f))
        if f in edits
        else F.col(f)
        for f in IDENTITY_FIELDS
    }
    status = F.when(act == "approve", "approved").when(update, "manual_override").when(act == "reject", "rejected")
    evidence = merge_json(
        F.col("evidence_json"),
        {
            "review_status": status,
            "review_note": F.when(update, F.col("note")),
            "reject_reason": F.when(act == "reject", F.col("note")),
        },
    )
    settled = act.isin("approve", "update", "reject")
    return joined.select(
        "raw_id",
        F.when(update, canonical_key(fields)).otherwise(F.col("canonical_key")).alias("canonical_key"),
        *[fields[f].alias(f) for f in IDENTITY_FIELDS],
        F.when(act.isin("approve", "update"), 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(touched, F.col("needs_review") & ~settled).otherwise(F.col("needs_review")).alias("needs_review"),
        F.when(settled, evidence).otherwise(F.col("evidence_json")).alias("evidence_json"),
    )


TEXT_FIELDS = ("player_name", "manufacturer", "set_name", "subset", "card_number", "parallel", "slab_grader")


def manual_corrections(failures: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows for corrected failures, failures that remain)."""
    one = first_by(corrections, ["raw_id"], ["card_id"])
    fixed = one.join(failures.select("raw_id"), "raw_id", "left_semi").select(
        "*", F.lit("manual").alias("parser_method"), F.lit(1.0).alias("parser_confidence")
    )
    return fixed, failures.join(one.select("raw_id"), "raw_id", "left_anti")


def sales_to_raw(sales: DataFrame) -> DataFrame:
    """Raw rows of imported sales with a stable external id, one per id with its number of copies."""
    ext = sale_text.stable_external_id(
        F.col("external_sale_id"), F.col("platform"), F.col("raw_title"), F.col("sold_at"), F.col("price_usd"),
        F.col("listing_type"), F.col("raw_text"),
    )
    keep = ["platform", "listing_type", "verified", "raw_text", "warnings", "search_query", "external_sale_id"]
    raw = sales.select(
        ext.alias("external_id"),
        F.to_json(F.struct(*keep)).alias("raw_json"),
        "raw_title",
        F.col("price_usd").alias("raw_price"),
        "sold_at",
    )
    # The JSON comes first, so it decides and is carried once; what is the same in all rows stays outside.
    rest = [c for c in raw.columns if c != "external_id"]
    one = raw.groupBy("external_id").agg(F.min(F.struct(*rest)).alias("_r"), F.count(F.lit(1)).alias("copies"))
    return one.select(
        "external_id", F.lit(sale_text.SOURCE).alias("source"), "_r.raw_title", "_r.raw_price", F.lit("USD").alias("raw_currency"), "_r.sold_at", "_r.raw_json", "copies"
    )


def import_sales(sales: DataFrame, stored: DataFrame, card: DataFrame, allow_clean: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new raw rows, new clean rows, one row of counts); known external ids are skipped."""
    known = stored.where(F.col("source") == sale_text.SOURCE).select("external_id").distinct().withColumn("_known", F.lit(True))
    # Known ids are marked where the rows of an id have met, before they are stored: then nothing is exchanged again.
    raw = stage(sales_to_raw(sales).join(known, "external_id", "left"), "import_raw")
    fresh = raw.where(F.col("_known").isNull()).drop("_known")
    fresh = stage(with_title_fields(fresh.withColumn("raw_id", F.col("external_id"))), "import_parsed")
    good, bad = confidence_gate(fresh)
    if not allow_clean:
        good, bad = good.limit(0), bad.limit(0)
    total = raw.agg(F.sum("copies").alias("n")).scalar()
    done, failed = (d.agg(F.count(F.lit(1)).alias("n")).scalar() for d in (good, bad))
    counts = fresh.agg(F.count(F.lit(1)).alias("inserted_raw")).select(
        "inserted_raw",
        done.alias("inserted_clean"),
        (F.coalesce(total, F.lit(0)) - F.col("inserted_raw")).alias("skipped_duplicates"),
        failed.alias("failed_clean"),
    )
    return fresh.drop("p", "copies"), clean_rows(good, card, "cardladder_"), counts


def unmapped_specs(card: DataFrame, spec_map: DataFrame) -> DataFrame:
    """Cards without a population spec id, newest first."""
    return card.join(spec_map.select("card_id"), "card_id", "left_anti").orderBy(F.col("card_year").desc(), "card_id")
