"""Title parsing, identity, sale-text, name and feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slabmill.catalog.registry import query, view
from slabmill.functions import dates, event_text, identity, names, sale_text, titles
from slabmill.plans import events, parsing
from slabmill.sources import html, listings

# --- titles -------------------------------------------------------------------------
SET_WORDS = ("Panini Prizm", "Topps Chrome", "Donruss Optic", "Panini Select Silver Prizm", "National Treasures", "Base")
SUFFIXES = (" RC", " Auto /25", " Patch 1/1", " Rookie cert 1234567", "", " Blue Wave", " X-Fractor", " Gold /10", " Holo Prizm LeBron James", " Red Cracked Ice")


def _pick(items, index):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (1 + index).cast("int"))


def _part(m):
    return F.split_part(F.col("raw_id"), F.lit("-"), F.lit(3)).cast("bigint")


def listing_titles(m):
    """Raw listings with the varied wording real titles have."""
    part = _part(m)
    title = F.concat(F.replace(F.col("raw_title"), F.lit("Panini Prizm"), _pick(SET_WORDS, part % 6)), _pick(SUFFIXES, F.floor(part / 6) % 10))
    return m.tx_raw.withColumn("raw_title", title)


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


view("listing_titles", f"""
select * replace (replace(raw_title, 'Panini Prizm', {_sql_list(SET_WORDS)}[cast(1 + p % 6 as int)]) || {_sql_list(SUFFIXES)}[cast(1 + (p // 6) % 10 as int)] as raw_title)
from (select *, cast(split_part(raw_id, '-', 3) as bigint) p from tx_raw) r""")


def _case(table, subject="low", default="null"):
    arms = " ".join(f"when {subject} like '%{k}%' then '{v}'" for k, v in table)
    return f"case {arms} else {default} end"


def _re(p: str, group: int = 1, text="raw_title") -> str:
    return f"nullif(regexp_extract({text}, '{p}', {group}), '')"


_implied = " ".join(f"when '{k}' then '{v}'" for k, v in titles.SET_MANUFACTURER.items())
view("title_parts", f"""
select *, lower(raw_title) low, {_case(titles.SETS, 'lower(raw_title)')} st, cast({_re(titles.YEAR)} as int) yr, {_re(titles.CARD_NUMBER)} num,
 upper({_re(titles.GRADE)}) gr, cast({_re(titles.GRADE, 2)} as double) gd, {_re(titles.CERT)} cert, {_re(titles.PRINT_RUN)} run from listing_titles""")
view("parsed_titles", f"""
select raw_id, source, raw_price, sold_at, yr card_year, mk manufacturer, st set_name, {_case(titles.PARALLELS, 'low', "coalesce('/' || run, 'Base')")} parallel, num card_number,
 gr slab_grader, gd slab_grade, cert cert_number, regexp_matches(low, '\\b(rookie|rc)\\b') is_rookie, regexp_matches(low, '\\b(auto(?:graph)?)\\b') has_auto,
 low like '%patch%' or low like '%rpa%' has_patch, low like '%1/1%' or low like '%1 of 1%' or low like '%one of one%' is_one_of_one,
 round(case when gr is not null and gd is not null then pts + 0.20 when yr is not null and mk is not null and st is not null and num is not null then greatest(pts, 0.85) else pts end, 3) confidence,
 case when not (gr is not null and gd is not null) and yr is not null and mk is not null and st is not null and num is not null then 'regex_raw' else 'regex' end as method
from (select *, case when yr is not null then 0.25 else 0 end + case when mk is not null then 0.15 else 0 end + case when st is not null then 0.25 else 0 end
  + case when num is not null then 0.15 else 0 end pts from (
  select *, coalesce({_case(titles.MANUFACTURERS)}, case st {_implied} end) mk from title_parts) a) b""")


@query("f14_title_fields", "select * exclude (source, raw_price, sold_at, confidence, method) from parsed_titles")
def _(m):
    return titles.with_title_fields(listing_titles(m)).select("raw_id", "p.*").drop("confidence", "method")


@query("f15_parse_confidence", "select raw_id, confidence, method from parsed_titles", confidence=3)
def _(m):
    return titles.with_title_fields(listing_titles(m)).select("raw_id", "p.confidence", "p.method")


# --- pending work -----------------------------------------------------------------------
# Every third raw row is already cleaned, every seventh has failed before.
view("done_rows", "select raw_id from listing_titles where cast(split_part(raw_id, '-', 1) as bigint) % 3 = 0")
view("failed_rows", "select raw_id, 'old' reason from listing_titles where cast(split_part(raw_id, '-', 1) as bigint) % 7 = 0")


def _order_no():
    return F.split_part(F.col("raw_id"), F.lit("-"), F.lit(1)).cast("bigint")


def _done(m):
    return m.tx_raw.where(_order_no() % 3 == 0).select("raw_id")


def _failed(m):
    return m.tx_raw.where(_order_no() % 7 == 0).select("raw_id", F.lit("old").alias("reason"))


@query("j04_pending_anti_join", """
select raw_id from listing_titles where source = 'ebay' and raw_id not in (select raw_id from done_rows) and raw_id not in (select raw_id from failed_rows)""")
def _(m):
    return parsing.pending_raw(listing_titles(m), _done(m), _failed(m)).select("raw_id")


@query("t09_pending_batch", """
select raw_id from listing_titles where source = 'ebay' and raw_id not in (select raw_id from done_rows) and raw_id not in (select raw_id from failed_rows)
order by raw_id limit 1000""")
def _(m):
    return parsing.pending_raw(listing_titles(m), _done(m), _failed(m)).select("raw_id").orderBy("raw_id").limit(1000)


# The catalogue the titles can match: the market's cards under real set names.
view("catalogue", f"""
select card_id, card_year, mk manufacturer, s set_name, card_number, parallel from (
 select *, {_sql_list(('Prizm', 'Topps Chrome', 'Donruss Optic', 'Select', 'National Treasures', 'Prizm'))}[cast(1 + card_id % 6 as int)] s,
  case when card_id % 6 = 1 then 'Topps' else 'Panini' end mk from (select * replace ({_case(titles.PARALLELS, "parallel", "'Base'")} as parallel) from card_master) q) c""")


def _catalogue(m):
    cid = F.col("card_id")
    word = F.col("parallel")
    from slabmill.functions.cards import first_match

    return m.card_master.select(
        "card_id", "card_year", F.when(cid % 6 == 1, "Topps").otherwise("Panini").alias("manufacturer"),
        _pick(("Prizm", "Topps Chrome", "Donruss Optic", "Select", "National Treasures", "Prizm"), cid % 6).alias("set_name"),
        "card_number", first_match(word, titles.PARALLELS, F.lit("Base")).alias("parallel"),
    )


CORE = "card_year is not null and manufacturer is not null and set_name is not null and card_number is not null"
view("resolved_titles", f"""
select p.*, case when {CORE.replace('card_year', 'p.card_year').replace('manufacturer', 'p.manufacturer').replace('set_name', 'p.set_name').replace('card_number', 'p.card_number')}
 then c.card_id end card_id from parsed_titles p left join catalogue c on c.card_year = p.card_year and c.manufacturer = p.manufacturer
 and c.set_name = p.set_name and c.card_number = p.card_number and c.parallel = p.parallel""")


@query("j12_resolve_card", "select raw_id, card_id from resolved_titles")
def _(m):
    return parsing.resolve_card(titles.with_title_fields(listing_titles(m)), _catalogue(m)).select("raw_id", "card_id")


view("parse_pending_rows", """
select * from resolved_titles where source = 'ebay' and raw_id not in (select raw_id from done_rows) and raw_id not in (select raw_id from failed_rows)""")


@query("d42_parse_pending", """
select raw_id, card_id, slab_grader, slab_grade, cert_number, raw_price price_usd, sold_at, confidence parser_confidence, method parser_method
from parse_pending_rows where confidence >= 0.5 and raw_price is not null""", price_usd=8, parser_confidence=3)
def _(m):
    clean, _bad = parsing.parse_pending(listing_titles(m), _done(m), _failed(m), _catalogue(m))
    return clean


@query("p11_confidence_gate", "select raw_id from parsed_titles where confidence >= 0.75 and raw_price is not null")
def _(m):
    parsed = titles.with_title_fields(listing_titles(m))
    good, _bad = parsing.confidence_gate(parsed)
    return good.where(F.col("p.confidence") >= 0.75).select("raw_id")


view("short_titles", "select *, case when p % 4 = 0 then 'lot of cards' when p % 4 = 1 then '2018 card #5' else raw_title end short_title from listing_titles")


@query("k06_quarantine", f"""
with t as (select raw_id, raw_price, short_title raw_title, lower(short_title) low from short_titles),
s as (select *, case when {_re(titles.YEAR)} is not null then .25 else 0 end + case when {_case(titles.MANUFACTURERS)} is not null or {_case(titles.SETS)} is not null then .15 else 0 end
 + case when {_case(titles.SETS)} is not null then .25 else 0 end + case when {_re(titles.CARD_NUMBER)} is not null then .15 else 0 end
 + case when {_re(titles.GRADE)} is not null then .2 else 0 end c from t)
select raw_id, 'low confidence ' || printf('%.3f', c) reason from s where c < 0.5""")
def _(m):
    part = _part(m)
    short = F.when(part % 4 == 0, "lot of cards").when(part % 4 == 1, "2018 card #5").otherwise(F.col("raw_title"))
    parsed = titles.with_title_fields(listing_titles(m).withColumn("raw_title", short))
    return parsing.confidence_gate(parsed)[1]


# --- identity -----------------------------------------------------------------------------
def _phrase(p: str) -> str:
    return f"case when regexp_matches(low, '(^|[^a-z0-9]){p.lower()}([^a-z0-9]|$)') then '{p}' end"


def _slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


_id_points = " + ".join(f"case when {c} is not null then {p} else 0 end" for c, p in identity.FIELD_POINTS.items())
view("identity_text", """
select raw_id, source, raw_price, sold_at, trim(regexp_replace(replace(raw_title, '≈', ' '), '\\s+', ' ', 'g')) raw_title,
 json_extract_string(raw_json, '$.search_query') q from listing_titles""")
view("identity_parts", f"""
select *, {_case(identity.SETS)} set_name, cast({_re(titles.YEAR)} as int) card_year, upper({_re(titles.GRADE)}) slab_grader, cast({_re(titles.GRADE, 2)} as double) slab_grade,
 cast({_re(titles.PRINT_RUN)} as int) print_run, upper(trim({_re(identity.CARD_NUMBER)}, '.')) num, {_case([(s.lower(), s) for s in identity.SUBSETS])} subset,
 coalesce(nullif(trim(regexp_replace(q, '{identity.QUERY_TAIL}', '')), ''), {_case([(n.lower(), n) for n in identity.KNOWN_PLAYERS])}) player_name,
 regexp_matches(low, '\\b(rookie|rc)\\b') is_rookie, regexp_matches(low, '\\b(auto|autograph)\\b') has_auto, low like '%patch%' or low like '%rpa%' has_patch,
 list_filter([{', '.join(_phrase(p) for p in identity.PARALLELS)}], lambda x: x is not null) found0
from (select *, lower(raw_title) low from identity_text) t""")
view("identity_fields", f"""
select * exclude (found0, num), case when num not in ('NO', '') then num end card_number,
 coalesce({_case(identity.MANUFACTURERS)}, case when set_name = 'Bowman Chrome' then 'Bowman' else case set_name {_implied} end end) manufacturer,
 case when low like '%prizm%' and coalesce(set_name, '') not in ('Prizm', 'Prizm Black') and len(list_filter(found0, lambda x: x like '%Prizm%')) = 0
  then list_append(found0, 'Prizm') else found0 end found from identity_parts""")
view("card_identity_candidates", f"""
select raw_id, concat_ws('|', {_slug('player_name')}, {_slug('manufacturer')}, cast(card_year as varchar), {_slug('set_name')}, {_slug('subset')}, {_slug("'#' || card_number")},
  {_slug('parallel')}, {_slug("'/' || cast(print_run as varchar)")}, case when is_rookie then 'rookie' end, case when has_auto then 'auto' end, case when has_patch then 'patch' end) canonical_key,
 player_name, manufacturer, card_year, set_name, subset, card_number, parallel, print_run, is_rookie, has_auto, has_patch, slab_grader, slab_grade, confidence,
 confidence < 0.85 needs_review, q search_query, raw_title, raw_price, sold_at
from (select *, round({_id_points}, 3) confidence, case when low like '%prizm blue and silver%' or low like '%blue and silver prizm%' then 'Blue and Silver Prizm'
  when len(found) = 0 then 'Base' else array_to_string(list_filter(found, lambda x, i: len(list_filter(found[1:i - 1], lambda e: contains(lower(e), lower(x)))) = 0), ' / ') end parallel
 from identity_fields) f""")
ID_COLUMNS = "raw_id, canonical_key, player_name, manufacturer, card_year, set_name, subset, card_number, parallel, print_run, is_rookie, has_auto, has_patch, slab_grader, slab_grade, confidence, needs_review"


def candidates(m):
    return m.stored("identity", lambda: parsing.materialize_identities(listing_titles(m), m.tx_raw.select("raw_id").limit(0)))


@query("f16_identity_fields", f"select {ID_COLUMNS} from card_identity_candidates", confidence=3)
def _(m):
    q = F.nullif(F.get_json_object("raw_json", "$.search_query"), F.lit(""))
    out = identity.with_identity(listing_titles(m), F.col("raw_title"), q)
    return out.select("raw_id", "i.*").drop("evidence_json")


@query("j05_unidentified", """
select raw_id from tx_raw where source = 'ebay' and raw_id not in (select raw_id from done_rows) order by raw_id limit 500""")
def _(m):
    return parsing.identity_pending(m.tx_raw, _done(m), "ebay", 500).select("raw_id")


@query("d43_materialize_identities", f"""
select {ID_COLUMNS} from card_identity_candidates where raw_id not in (select raw_id from done_rows)""", confidence=3)
def _(m):
    return parsing.materialize_identities(listing_titles(m), _done(m)).drop("evidence_json")


@query("d43_materialize_counts", """
select count(*) processed, count(*) filter (canonical_key <> '') inserted, count(*) filter (canonical_key = '') skipped
from card_identity_candidates where raw_id not in (select raw_id from done_rows)""")
def _(m):
    pending = parsing.identity_pending(listing_titles(m), _done(m))
    return parsing.identity_counts(pending, parsing.materialize_identities(listing_titles(m), _done(m)))


# Reviewers approve, reword or reject by order number.
view("reviewed", f"""
select c.raw_id, case when a = 1 then regexp_replace(canonical_key, '^[^|]*', 'stephen-curry') else canonical_key end canonical_key,
 case when a = 1 then 'Stephen Curry' else player_name end player_name, case when a in (0, 1) then 1.0 else confidence end confidence,
 needs_review and a > 2 needs_review, case a when 0 then 'approved' when 1 then 'manual_override' when 2 then 'rejected' end review_status,
 case a when 2 then 'blurry' end reject_reason, search_query
from (select *, cast(split_part(raw_id, '-', 1) as bigint) % 11 a from card_identity_candidates) c""")


def reviewed(m):
    a = _order_no() % 11
    base = candidates(m)
    actions = base.where(a <= 2).select(
        "raw_id", F.lit(1).alias("seq"), _pick(("approve", "update", "reject"), a).alias("action"),
        F.when(a == 2, "blurry").alias("note"), F.when(a == 1, "Stephen Curry").alias("new_player_name"),
    )
    return parsing.review_actions(base, actions)


def _with_review(df):
    return df.withColumn("review_status", F.get_json_object("evidence_json", "$.review_status"))


@query("d44_review_actions", "select raw_id, canonical_key, player_name, confidence, needs_review, review_status, reject_reason from reviewed", confidence=3)
def _(m):
    out = _with_review(reviewed(m)).withColumn("reject_reason", F.get_json_object("evidence_json", "$.reject_reason"))
    return out.select("raw_id", "canonical_key", "player_name", "confidence", "needs_review", "review_status", "reject_reason")


@query("f24_json_merge", "select raw_id, search_query, review_status from reviewed where review_status is not null")
def _(m):
    out = _with_review(reviewed(m)).where("review_status is not null")
    return out.select("raw_id", F.get_json_object("evidence_json", "$.search_query").alias("search_query"), "review_status")


@query("d45_manual_corrections", """
select f.raw_id, cast(split_part(f.raw_id, '-', 3) as bigint) card_id, r.raw_price price_usd, 'manual' parser_method, 1.0 parser_confidence
from failed_rows f join tx_raw r on r.raw_id = f.raw_id where cast(split_part(f.raw_id, '-', 1) as bigint) % 2 = 0""", price_usd=8, parser_confidence=1)
def _(m):
    fix = m.tx_raw.where(_order_no() % 2 == 0).select("raw_id", _part(m).alias("card_id"), F.col("raw_price").alias("price_usd"))
    fixed, _left = parsing.manual_corrections(_failed(m), fix)
    return fixed.select("raw_id", "card_id", "price_usd", "parser_method", "parser_confidence")


@query("d45_failures_left", "select raw_id from failed_rows where cast(split_part(raw_id, '-', 1) as bigint) % 2 <> 0")
def _(m):
    fix = m.tx_raw.where(_order_no() % 2 == 0).select("raw_id", _part(m).alias("card_id"), F.col("raw_price").alias("price_usd"))
    return parsing.manual_corrections(_failed(m), fix)[1].select("raw_id")


@query("d54_unmapped_specs", "select card_id, card_year from card_master where card_id % 4 <> 0")
def _(m):
    spec_map = m.card_master.where("card_id % 4 = 0").select("card_id")
    return parsing.unmapped_specs(m.card_master, spec_map).select("card_id", "card_year")


# --- sale text, links, feeds ----------------------------------------------------------------
view("quick_sales", """
select tx_id, case length(tx_id) % 3 when 0 then 'EBAY' when 1 then 'GOLDIN' else 'PRISTINE AUCTION' end platform,
 concat('2018 Panini Prizm Card #', card_id, ' ', coalesce(slab_grader, 'raw')) raw_title, cast(floor(price_usd) + 0.25 as decimal(14, 2)) price, sold_at,
 case length(tx_id) % 4 when 0 then 'Best Offer' when 1 then 'Auction' when 2 then 'Buy Now' end listing_type, slab_grader is not null verified from tx_clean""")


def quick_sales(m):
    n = F.length("tx_id")
    return m.sales_from_lines(m.dealt("lineitem")).select(
        "tx_id", F.when(n % 3 == 0, "EBAY").when(n % 3 == 1, "GOLDIN").otherwise("PRISTINE AUCTION").alias("platform"),
        F.concat(F.lit("2018 Panini Prizm Card #"), F.col("card_id"), F.lit(" "), F.coalesce("slab_grader", F.lit("raw"))).alias("raw_title"),
        (F.floor("price_usd") + F.lit(0.25)).cast("decimal(14,2)").alias("price"), "sold_at",
        F.when(n % 4 == 0, "Best Offer").when(n % 4 == 1, "Auction").when(n % 4 == 2, "Buy Now").alias("listing_type"),
        F.col("slab_grader").isNotNull().alias("verified"),
    )


def _record():
    return sale_text.quick_record(F.col("platform"), F.col("raw_title"), F.col("price"), F.col("sold_at"), F.col("listing_type"), F.col("verified"))


RECORD_SQL = """concat_ws(' ', platform, raw_title, 'Price $' || format('{:,.2f}', price::double), case when verified then 'verified' end, listing_type,
 strftime(sold_at, '%b %-d, %Y'))"""


@query("f38_quick_record", f"select tx_id, {RECORD_SQL} raw_text from quick_sales")
def _(m):
    return quick_sales(m).select("tx_id", _record().alias("raw_text"))


@query("f18_record_fields", """
select tx_id, platform, raw_title, price::double price_usd, sold_at, listing_type, verified, case when listing_type is null and platform <> 'PRISTINE AUCTION' then 1 else 0 end n_warnings
from (select * replace (case when listing_type is null and platform = 'PRISTINE AUCTION' then 'Auction' else listing_type end as listing_type) from quick_sales) q""", price_usd=2)
def _(m):
    r = sale_text.with_record_fields(quick_sales(m), _record())
    return r.select("tx_id", "s.platform", "s.raw_title", F.col("s.price_usd").cast("double").alias("price_usd"), "s.sold_at", "s.listing_type",
                    "s.verified", F.size("s.warnings").alias("n_warnings"))


def _pages(m):
    """One pasted page per sale: a heading, that sale and a second one, line by line."""
    lines = F.concat_ws("\n", F.lit("Sales History"), F.col("platform"), F.col("raw_title"),
                        F.concat(F.lit("Price $"), F.format_number("price", 2)), F.date_format("sold_at", "MMM d, yyyy"), _record(), F.lit(""))
    return quick_sales(m).select("tx_id", lines.alias("page"))


@query("u02_split_records", f"""
select tx_id, 0 record_no, concat_ws(' ', platform, raw_title, 'Price $' || format('{{:,.2f}}', price::double), strftime(sold_at, '%b %-d, %Y')) record_text from quick_sales
union all select tx_id, 1, {RECORD_SQL} from quick_sales""")
def _(m):
    return _pages(m).select("tx_id", F.posexplode(sale_text.split_records(F.col("page"))).alias("record_no", "record_text"))


@query("s04_sale_text", """
select platform, count(*) * 2 n, round(sum(price::double) * 2, 2) total from quick_sales group by 1""", total=1)
def _(m):
    sales = listings.sales_from_text(_pages(m), "page", F.lit("basket"))
    return sales.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price_usd").cast("double")).alias("total"))


view("sale_links", f"""
select tx_id, {RECORD_SQL} description, case length(tx_id) % 5 when 0 then 'https://www.ebay.com/itm/' || card_id || '?x=1' when 1 then 'goldin.co/item/lot-' || card_id
 when 2 then 'https://app.example.com/sale?saleId=S%2D' || card_id when 3 then 'https://fanaticscollect.com/weekly/' || card_id || '/x' else 'https://nowhere.example.com/a' end as value,
 card_id from quick_sales join tx_clean using (tx_id)""".replace("platform, raw_title, 'Price", "platform, raw_title, 'Price").replace("sold_at, '%b", "quick_sales.sold_at, '%b"))
view("link_ids", """
select *, case length(tx_id) % 5 when 0 then 'ebay-' || card_id when 1 then 'goldin-item-lot-' || card_id when 2 then 'S-' || card_id
 when 3 then 'fanatics-weekly-' || card_id end external_sale_id from sale_links""")


def sale_links(m):
    cid, n = F.col("card_id").cast("string"), F.length("tx_id") % 5
    url = (
        F.when(n == 0, F.concat(F.lit("https://www.ebay.com/itm/"), cid, F.lit("?x=1")))
        .when(n == 1, F.concat(F.lit("goldin.co/item/lot-"), cid))
        .when(n == 2, F.concat(F.lit("https://app.example.com/sale?saleId=S%2D"), cid))
        .when(n == 3, F.concat(F.lit("https://fanaticscollect.com/weekly/"), cid, F.lit("/x")))
        .otherwise(F.lit("https://nowhere.example.com/a"))
    )
    q = quick_sales(m).withColumn("card_id", F.split_part("tx_id", F.lit("-"), F.lit(3)))
    return q.select("tx_id", _record().alias("description"), url.alias("value"))


@query("f17_sale_id_from_url", "select tx_id, external_sale_id from link_ids")
def _(m):
    return sale_links(m).select("tx_id", sale_text.sale_id_from_url(F.col("value")).alias("external_sale_id"))


@query("s05_sale_links", "select external_sale_id, count(distinct description) n from link_ids group by 1")
def _(m):
    sales = listings.sales_from_links(sale_links(m), F.lit("basket"))
    return sales.groupBy("external_sale_id").agg(F.count(F.lit(1)).alias("n"))


@query("set05_distinct_links", "select distinct description, external_sale_id from link_ids")
def _(m):
    ids = sale_links(m).select("description", sale_text.sale_id_from_url(F.col("value")).alias("external_sale_id"))
    return ids.dropDuplicates(["description", "external_sale_id"])


EXT_SQL = """'clm-' || substr(sha256(concat_ws('|', platform, lower(raw_title), strftime(sold_at, '%Y-%m-%d'), printf('%.2f', price::double), lower(coalesce(lt, '')),
 lower(raw_text))), 1, 32)"""
view("text_sales", f"""
select *, {EXT_SQL} external_id from (select platform, raw_title, price, sold_at, coalesce(listing_type, case when platform = 'PRISTINE AUCTION' then 'Auction' end) lt,
 {RECORD_SQL} raw_text from quick_sales) q""")


@query("f19_stable_external_id", "select raw_text, external_id from text_sales")
def _(m):
    r = sale_text.with_record_fields(quick_sales(m), _record()).select("s.*")
    ext = sale_text.stable_external_id(F.lit(None).cast("string"), F.col("platform"), F.col("raw_title"), F.col("sold_at"), F.col("price_usd"), F.col("listing_type"), F.col("raw_text"))
    return r.select("raw_text", ext.alias("external_id"))


def _import(m):
    page = quick_sales(m).select(_record().alias("page"))
    sales = listings.sales_from_text(page, "page", F.lit("basket"))
    known = parsing.sales_to_raw(sales.where(F.col("platform") == "GOLDIN")).select("source", "external_id")
    return parsing.import_sales(sales, known, _catalogue(m))


@query("d46_import_counts", """
select count(distinct external_id) filter (platform <> 'GOLDIN') inserted_raw, count(distinct external_id) filter (platform <> 'GOLDIN') inserted_clean,
 count(*) - count(distinct external_id) filter (platform <> 'GOLDIN') skipped_duplicates, cast(0 as bigint) failed_clean from text_sales""")
def _(m):
    return _import(m)[2]


@query("d46_import_sales", """
select external_id raw_id, min(price)::double price_usd, case when any_value(raw_title) like '%PSA' or any_value(raw_title) like '%BGS' or true then 'cardladder_regex' end parser_method
from text_sales where platform <> 'GOLDIN' group by 1""", price_usd=2)
def _(m):
    return _import(m)[1].select("raw_id", "price_usd", "parser_method")


@query("f25_search_url", f"""
select p_partkey, '{sale_text.SEARCH_URL}' || url_encode(concat(p_name, ' & ', p_brand, '~*')) url from part""")
def _(m):
    q = F.concat(F.col("p_name"), F.lit(" & "), F.col("p_brand"), F.lit("~*"))
    return m.raw("part").select("p_partkey", sale_text.search_url(q).alias("url"))


@query("s02_listing_json", """
select external_id, raw_title, floor(raw_price) + 0.25 raw_price, 'USD' raw_currency, 'ebay_active' source, sold_at from tx_raw where length(raw_id) % 5 <> 0""", raw_price=2)
def _(m):
    text = F.to_json(
        F.struct(
            F.when(F.length("raw_id") % 5 != 0, F.col("external_id")).alias("itemId"),
            F.col("raw_title").alias("title"),
            F.struct(F.format_string("%.2f", F.floor("raw_price") + F.lit(0.25)).alias("value")).alias("price"),
            F.date_format("sold_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("itemCreationDate"),
        )
    )
    out = listings.listings_from_text(m.tx_raw.select(text.alias("value")))
    return out.select("external_id", "raw_title", "raw_price", "raw_currency", "source", "sold_at")


@query("s03_auction_rows", """
select 'goldin:' || external_id external_id, raw_title, floor(raw_price) + 0.25 raw_price, 'goldin' source, sold_at, strftime(sold_at, '%Y-%m-%d') json_sold from tx_raw""", raw_price=2)
def _(m):
    frame = m.tx_raw.select(
        F.col("raw_title").alias("Lot_Title"), F.format_string("%.2f", F.floor("raw_price") + F.lit(0.25)).alias("PRICE"),
        F.date_format("sold_at", "yyyy-MM-dd").alias("Sold_At"), F.col("external_id").alias("Lot_ID"),
    )
    out = listings.auction_rows(frame, "goldin")
    return out.select("external_id", "raw_title", "raw_price", "source", "sold_at", F.get_json_object("raw_json", "$.sold_at").alias("json_sold"))


@query("s06_explode_population", """
select timestamp '2000-01-01' snapshot_date, card_id, 'PSA' grader, grade, pop_count from pop_snapshots""")
def _(m):
    entry = F.struct(F.col("grade").cast("string").alias("Grade"), F.col("pop_count").cast("string").alias("pop"))
    docs = m.pop_snapshots.groupBy("card_id", "snapshot_date").agg(F.to_json(F.struct(F.collect_list(entry).alias("PSAPopulation"))).alias("doc"))
    return listings.explode_population(docs, "doc", m.as_of + F.expr("interval 5 hours"))


@query("s07_seed_cards", """
select c.card_id, p.player_id from card_master c join player_master p on p.player_id = c.player_id where c.card_id % 2 = 0""")
def _(m):
    named = m.card_master.join(m.player_master.select("player_id", "name"), "player_id")
    label = F.when(F.col("card_id") % 2 == 0, F.col("name")).otherwise("Nobody")
    return listings.resolve_seed_cards(named.select("card_id", label.alias("player")), m.player_master)


@query("s10_explode_html_rows", """
with p as (select page_id, regexp_replace(html, '(?s)<!--(.*?)-->', '\\1', 'g') h from pages),
t as (select page_id, unnest(regexp_extract_all(h, '(?is)<(?:nav)\\b[^>]*>.*?</(?:nav)>')) t, generate_subscripts(regexp_extract_all(h, '(?is)<(?:nav)\\b[^>]*>.*?</(?:nav)>'), 1) - 1 table_no from p),
r as (select page_id, table_no, unnest(regexp_extract_all(t, '(?is)<(?:li)\\b[^>]*>.*?</(?:li)>')) r, generate_subscripts(regexp_extract_all(t, '(?is)<(?:li)\\b[^>]*>.*?</(?:li)>'), 1) - 1 row_no from t)
select page_id, cast(table_no as int) table_no, cast(row_no as int) row_no, len(regexp_extract_all(r, '(?is)<(?:a)\\b[^>]*>.*?</(?:a)>')) n_cells,
 trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract_all(r, '(?is)<(?:a)\\b[^>]*>.*?</(?:a)>')[1], '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) first_cell from r""")
def _(m):
    rows = html.explode_html_rows(m.raw("pages"), table="nav", row="li", cell="a")
    return rows.select("page_id", "table_no", "row_no", F.size("cells").cast("bigint").alias("n_cells"), F.get("cells", F.lit(0)).alias("first_cell"))


@query("u03_page_rows", """
with c as (select c_custkey, c_nationkey, c_name, c_mktsegment, n_name, c_nationkey * 1000000 + c_custkey // 20 page_id from customer join nation on n_nationkey = c_nationkey),
k as (select *, row_number() over (partition by page_id order by c_custkey) i from c)
select page_id, 0 table_no, 'list' table_id, cast(i - 1 as int) row_no, 'c' row_class, c_name || ' č é' c0, c_mktsegment || ' & ' || n_name || ' ' || c_custkey || ' < 5' c1,
 cast(2 as bigint) n_cells, c_name || ' č é' stat from k
union all
select page_id, cast(i as int), 'in' || c_custkey, 0, null, n_name, c_custkey || ' < 5', cast(2 as bigint), null from k""")
def _(m):
    customer, nation = m.raw("customer"), m.raw("nation")
    known = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    key = F.col("c_nationkey").cast("bigint") * 1_000_000 + F.floor(F.col("c_custkey") / 20)
    # Nested tables, numeric and named entities, unquoted attributes, a misleading data-id and no end tags of rows and cells.
    row = F.format_string(
        '<tr class=c data-id="7"><td data-stat=name title="a id=b">%s &#269; &#xE9;<td data-id=x><i>%s</i>&nbsp;&amp; <table data-id="no" id=in%d><tr><td>%s<th>%d &lt; 5</table>',
        "c_name", "c_mktsegment", F.col("c_custkey").cast("bigint"), "n_name", F.col("c_custkey").cast("bigint"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]), "\n")
    pages = known.groupBy(key.alias("page_id")).agg(F.concat(F.lit("<html><p>x<!-- <table id='list'><tbody>"), body, F.lit("</table> --><td>stray</td></html>")).alias("html"))
    cell = lambda i: F.get("cells", F.lit(i))
    return html.explode_html_rows(pages).select(
        "page_id", "table_no", "table_id", "row_no", "row_class", cell(0).alias("c0"), cell(1).alias("c1"),
        F.size("cells").cast("bigint").alias("n_cells"), F.try_element_at("stats", F.lit("name")).alias("stat"),
    )


# --- names and event feeds ---------------------------------------------------------------------
view("feed_names", """
select event_id, user_id, ts, event_type, case event_id % 4 when 0 then upper(name) when 1 then replace(name, 'u', 'ü') when 2 then substr(name, 1, 10) || substr(name, 12)
 else 'Nobody Special' end player_name from events e join player_master p on p.player_id = e.user_id % 10""")


def feed_names(m):
    e = m.raw("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("user_id") % 10).cast("int").alias("player_id"))
    n, name = F.col("event_id") % 4, F.col("name")
    label = F.when(n == 0, F.upper(name)).when(n == 1, F.replace(name, F.lit("u"), F.lit("ü"))).when(n == 2, F.concat(F.substring(name, 1, 10), F.substring(name, 12, 99))).otherwise("Nobody Special")
    return e.join(m.player_master.select("player_id", "name"), "player_id").select("event_id", "user_id", "ts", "event_type", label.alias("player_name"))


view("name_map", """
with d as (select distinct player_name from feed_names),
f as (select player_name, arg_min(player_id, (-s, player_id)) pid from (select d.player_name, p.player_id,
  1 - levenshtein(strip_accents(lower(d.player_name)), strip_accents(lower(p.name))) / greatest(length(d.player_name), length(p.name)) s
  from d cross join player_master p) x where s >= 0.88 group by 1)
select d.player_name, coalesce((select min(player_id) from player_master p where lower(p.name) = lower(d.player_name)),
 (select min(player_id) from player_master p where strip_accents(lower(p.name)) = strip_accents(lower(d.player_name))), f.pid) player_id
from d left join f on f.player_name = d.player_name""")


@query("j13_resolve_names", "select event_id, f.player_name, player_id from feed_names f left join name_map n on n.player_name = f.player_name")
def _(m):
    return events.resolve_names(feed_names(m).select("event_id", "player_name"), m.player_master)


@query("f20_name_keys", """
select event_id, strip_accents(lower(player_name)) normalized, regexp_replace(lower(player_name), '[^\\p{L}\\p{N}]', '', 'g') name_key,
 trim(regexp_replace(lower(player_name), '[^a-z0-9]+', '-', 'g'), '-') slug from feed_names""")
def _(m):
    n = F.col("player_name")
    return feed_names(m).select("event_id", names.normalize_name(n).alias("normalized"), names.name_key(n).alias("name_key"), names.slugify(n).alias("slug"))


@query("u04_name_similarity", """
select event_id, greatest(1 - levenshtein(strip_accents(lower(player_name)), 'supplier#000000003') / greatest(length(player_name), 18),
 1 - levenshtein(array_to_string(list_sort(string_split(strip_accents(lower(player_name)), ' ')), ' '), 'supplier#000000003') / greatest(length(player_name), 18)) s from feed_names""", s=7)
def _(m):
    return feed_names(m).select("event_id", names.name_similarity(F.col("player_name"), F.lit("Supplier#000000003")).alias("s"))


STATUSES = ("Out", "Day-To-Day", "Questionable", "Active", "Suspended")
view("injury_feed", f"""
select event_id seq, player_name, {_sql_list(STATUSES)}[cast(1 + (event_id // 4) % 5 as int)] status, ts status_date, 'n' || event_id note from feed_names""")
view("injury_rows", """
select i.seq, n.player_id, case lower(status) when 'out' then 'injury_out' when 'day-to-day' then 'injury_dtd' when 'questionable' then 'injury_dtd' when 'active' then 'injury_return' end event_type,
 status_date event_date from injury_feed i join name_map n on n.player_name = i.player_name where n.player_id is not null and lower(status) <> 'suspended'""")
view("stored_events", "select player_id, event_type, event_date from player_events where event_id % 10 = 0")
view("injury_changes", """
with prior as (select player_id, max_by(event_type, event_date) pt from stored_events where event_type like 'injury%' group by 1),
c as (select r.*, pt, bool_or(event_type <> 'injury_return') over (partition by r.player_id order by event_date, seq) seen from injury_rows r left join prior on prior.player_id = r.player_id),
u as (select *, lag(event_type) over (partition by player_id order by event_date, seq) lt from c where pt is not null or seen)
select player_id, event_type, event_date from u where coalesce(lt, pt, 'x') <> event_type""")


def _injury_feed(m):
    return feed_names(m).select(
        F.col("event_id").alias("seq"), "player_name", _pick(STATUSES, F.floor(F.col("event_id") / 4) % 5).alias("status"),
        F.col("ts").alias("status_date"), F.concat(F.lit("n"), F.col("event_id")).alias("note"),
    )


def _stored_events(m):
    return m.player_events.where("event_id % 10 = 0")


@query("d47_injury_events", "select * from injury_changes c where not exists (select 1 from stored_events s where s.player_id = c.player_id and s.event_type = c.event_type and s.event_date = c.event_date)")
def _(m):
    return events.injury_events(_injury_feed(m), m.player_master, _stored_events(m)).drop("event_payload")


@query("w14_status_changes", "select * from injury_changes")
def _(m):
    typed = _injury_feed(m).withColumn("event_type", event_text.classify_injury(F.col("status"))).where("event_type is not null")
    named = events.resolve_names(typed, m.player_master).where("player_id is not null")
    rows = named.select("player_id", "event_type", F.col("status_date").alias("event_date"), "seq", F.col("note").alias("event_payload"))
    return events.status_changes(rows, _stored_events(m)).drop("event_payload")


@query("f21_classify_texts", f"""
select event_id, case lower({_sql_list(STATUSES)}[cast(1 + event_id % 5 as int)]) when 'out' then 'injury_out' when 'day-to-day' then 'injury_dtd' when 'questionable' then 'injury_dtd' when 'active' then 'injury_return' end injury,
 case event_id % 6 when 0 then 'signed' when 1 then 'call_up' when 2 then 'two_way' when 3 then 'traded' when 4 then null else 'call_up' end txn,
 case event_id % 4 when 0 then 'all_nba_1st' when 1 then 'all_nba_2nd' when 2 then 'all_nba_3rd' end tier from events""")
def _(m):
    n = F.col("event_id")
    texts = ("Re-signed G A B", "Converted from two-way to standard", "Signed to a two-way", "Acquired in a trade", "Waived", "Called up A B")
    # 'signed' wins only when no more specific phrase is present.
    return m.raw("events").select(
        "event_id", event_text.classify_injury(_pick(STATUSES, n % 5)).alias("injury"),
        event_text.classify_transaction(_pick(texts, n % 6)).alias("txn"), event_text.classify_award_tier(_pick(("1T", "2nd", "3T", "ORV"), n % 4)).alias("tier"),
    )


view("txn_feed", """
select event_id, case event_id % 3 when 0 then 'Signed F ' when 1 then 'Traded G ' else 'Waived C ' end || 'Player Num' || chr(cast(65 + user_id % 10 as int)) || ' to a two-year contract.' body,
 strftime(ts, '%b %-d') short_day, 'Player Num' || chr(cast(65 + user_id % 10 as int)) player_name from events""")


def _txn_feed(m):
    n = F.col("event_id")
    who = F.concat(F.lit("Player Num"), F.char((65 + F.col("user_id") % 10).cast("int")))
    body = F.concat(F.when(n % 3 == 0, "Signed F ").when(n % 3 == 1, "Traded G ").otherwise("Waived C "), who, F.lit(" to a two-year contract."))
    return m.raw("events").select("event_id", body.alias("body"), F.date_format(F.col("ts").cast("timestamp"), "MMM d").alias("short_day"))


@query("f22_player_in_sentence", "select event_id, player_name from txn_feed")
def _(m):
    return _txn_feed(m).select("event_id", event_text.player_in_sentence(F.col("body")).alias("player_name"))


@query("f04_short_date", "select event_id, cast(ts as date) as day_parsed from events")
def _(m):
    return _txn_feed(m).select("event_id", dates.short_date(F.col("short_day"), F.lit(2024)).alias("day_parsed"))


def _txn_players(m):
    return m.player_master.where("player_id < 10").select("player_id", F.concat(F.lit("player num"), F.lower(F.char(65 + F.col("player_id")))).alias("name"))


@query("d50_transaction_events", """
select distinct cast(user_id % 10 as int) player_id, case event_id % 3 when 0 then 'signed' else 'traded' end event_type, date_trunc('day', ts) event_date from events
where event_id % 3 < 2 and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-26'""")
def _(m):
    today = F.lit("2024-01-25").cast("date")
    cells = _txn_feed(m).select(F.array("short_day", F.lit("team"), "body").alias("cells"))
    rows = events.transaction_rows(cells, today)
    return events.transaction_events(rows, _txn_players(m), _stored_events(m), F.lit("2024-01-10").cast("date")).drop("event_payload")


AWARDS = ("mvp", "roy", "all_nba_1st", "scoring_title")
view("award_feed", f"""
select event_id, {_sql_list(AWARDS)}[cast(1 + event_id % 4 as int)] award_type, case when event_id % 2 = 0 then '2022-23' else '1999-00' end season, player_name from feed_names""")


@query("d49_award_events", """
select distinct player_id, award_type event_type, case when season = '2022-23' then timestamp '2023-06-30' else timestamp '2000-06-30' end event_date
from award_feed a join name_map n on n.player_name = a.player_name where award_type <> 'scoring_title' and player_id is not null""")
def _(m):
    n = F.col("event_id")
    feed = feed_names(m).select(_pick(AWARDS, n % 4).alias("award_type"), F.when(n % 2 == 0, "2022-23").otherwise("1999-00").alias("season"), "player_name")
    return events.award_events(feed, m.player_master, _stored_events(m)).drop("event_payload")


@query("set04_new_event_keys", """
select distinct player_id, event_type, event_date from player_events e where not exists (
 select 1 from stored_events s where s.player_id = e.player_id and s.event_type = e.event_type and s.event_date = e.event_date)""")
def _(m):
    return events.new_events(m.player_events, _stored_events(m)).drop("event_payload")


# Orders as a game log: two rows per game, nation pairs as playoff series.
view("team_rows", """
select case o_orderkey % 3 when 0 then '004' when 1 then '002' else '003' end || lpad(cast(o_orderkey as varchar), 9, '0') game_id, cast(o_orderdate as date) game_date,
 case when s = 0 then h else a end team, case when s = 0 then h || ' vs. ' || a else a || ' @ ' || h end matchup, case when (s = 0) = (o_custkey % 3 > 0) then 'W' else 'L' end wl
from (select *, 'T' || o_custkey % 4 h, 'U' || o_orderkey // 3 % 2 a from orders) o cross join (values (0), (1)) x(s) where not (s = 1 and o_orderkey % 13 = 0)""")
view("games", """
select game_id, min(game_date) game_date, max(team) filter (matchup like '%vs.%') home_team, max(team) filter (matchup not like '%vs.%') away_team,
 max(team) filter (wl = 'W') winner_team, substr(game_id, 1, 3) = '004' is_playoff, substr(game_id, 1, 3) = '003' is_all_star from team_rows group by game_id having count(*) >= 2""")
view("tally", """
select *, count(*) over (partition by season, series, winner_team order by game_date, game_id rows unbounded preceding) wins from (
 select *, least(home_team, away_team) || '-' || greatest(home_team, away_team) series,
  case when month(game_date) >= 10 then year(game_date) || '-' || lpad(cast((year(game_date) + 1) % 100 as varchar), 2, '0') else (year(game_date) - 1) || '-' || lpad(cast(year(game_date) % 100 as varchar), 2, '0') end season
 from games where is_playoff and winner_team is not null) g""")
view("playoffs", """
select t.*, wins >= 4 is_series_clincher, coalesce(series = fs, false) is_finals from tally t left join (
 select season, arg_max(series, (game_date, game_id)) fs from tally where wins >= 4 group by 1) f on f.season = t.season""")


def team_rows(m):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    home, away = F.concat(F.lit("T"), cust % 4), F.concat(F.lit("U"), F.floor(key / 3) % 2)
    prefix = F.when(key % 3 == 0, "004").when(key % 3 == 1, "002").otherwise("003")
    side = F.col("s")
    o = m.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    return o.where(~((side == 1) & (key % 13 == 0))).select(
        F.concat(prefix, F.lpad(key.cast("string"), 9, "0")).alias("game_id"), F.to_date("o_orderdate").alias("game_date"),
        F.when(side == 0, home).otherwise(away).alias("team"),
        F.when(side == 0, F.concat(home, F.lit(" vs. "), away)).otherwise(F.concat(away, F.lit(" @ "), home)).alias("matchup"),
        F.when((side == 0) == (cust % 3 > 0), "W").otherwise("L").alias("wl"),
    )


@query("d48_schedule_games", "select * from games")
def _(m):
    return events.schedule_games(team_rows(m))


@query("f33_game_kind", "select game_id, case when is_playoff then 'playoff' when is_all_star then 'all_star' else 'regular' end kind from games")
def _(m):
    return events.schedule_games(team_rows(m)).select("game_id", event_text.game_kind(F.col("game_id")).alias("kind"))


@query("w12_series_tally", "select game_id, season, series, winner_team, wins from tally")
def _(m):
    return events.series_tally(events.schedule_games(team_rows(m))).select("game_id", "season", "series", "winner_team", "wins")


@query("w13_finals_flags", "select game_id, is_series_clincher, is_finals from playoffs")
def _(m):
    return events.classified_playoffs(events.schedule_games(team_rows(m))).select("game_id", "is_series_clincher", "is_finals")


view("rosters", "select player_id, case player_id % 6 when 4 then 'U0' when 5 then 'U1' else 'T' || player_id % 6 end team from player_master")


def _rosters(m):
    n = F.col("player_id") % 6
    return m.player_master.select("player_id", F.when(n == 4, "U0").when(n == 5, "U1").otherwise(F.concat(F.lit("T"), n)).alias("team"))


@query("d48_playoff_events", """
select distinct player_id, case when is_series_clincher and is_finals then 'playoff_finals_win' when is_series_clincher then 'playoff_series_win' else 'playoff_win' end event_type,
 cast(game_date as timestamp) event_date from playoffs p join rosters r on r.team = p.winner_team""")
def _(m):
    return events.playoff_events(events.schedule_games(team_rows(m)), _rosters(m), _stored_events(m)).drop("event_payload")


@query("j15_roster_fan_out", "select game_id, player_id from playoffs p join rosters r on r.team = p.winner_team")
def _(m):
    games = events.classified_playoffs(events.schedule_games(team_rows(m)))
    return events.on_roster(games.select("game_id", "winner_team"), _rosters(m).withColumnRenamed("team", "winner_team"), "game_id", "player_id")


@query("d56_event_refresh", """
select 'awards' feed, (select count(*) from (select distinct player_id, award_type, season from award_feed a join name_map n on n.player_name = a.player_name
 where award_type <> 'scoring_title' and player_id is not null)) written
union all select 'injuries', (select count(*) from injury_changes c where not exists (select 1 from stored_events s where s.player_id = c.player_id and s.event_type = c.event_type and s.event_date = c.event_date))""")
def _(m):
    n = F.col("event_id")
    feed = feed_names(m).select(_pick(AWARDS, n % 4).alias("award_type"), F.when(n % 2 == 0, "2022-23").otherwise("1999-00").alias("season"), "player_name")

    def broken():
        raise ValueError("feed unavailable")

    def unreadable():
        return m.player_master.select("player_id", F.raise_error(F.lit("feed breaks off")).alias("event_type"))

    done, failed = events.event_refresh(
        {"injuries": lambda: events.injury_events(_injury_feed(m), m.player_master, _stored_events(m)), "transactions": broken, "captures": unreadable},
        {"awards": lambda: events.award_events(feed, m.player_master, _stored_events(m))},
        is_monday=True,
    )
    assert set(failed) == {"transactions", "captures"}
    return events.refresh_counts(done)


@query("f03_season_columns", """
select o_orderkey, 1990 + o_orderkey % 30 end_year_plain, 1990 + o_orderkey % 30 + 1 end_year, make_date(cast(1990 + o_orderkey % 30 + 1 as int), 6, 30)::timestamp award_day,
 case when month(o_orderdate) >= 10 then year(o_orderdate) || '-' || lpad(cast((year(o_orderdate) + 1) % 100 as varchar), 2, '0') else (year(o_orderdate) - 1) || '-' || lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0') end season_now
from orders""")
def _(m):
    y = (1990 + F.col("o_orderkey") % 30).cast("int")
    s = dates.season_label(y)
    return m.raw("orders").select(
        "o_orderkey", dates.season_end_year(y.cast("string")).cast("bigint").alias("end_year_plain"), dates.season_end_year(s).cast("bigint").alias("end_year"),
        dates.season_end_date(s).alias("award_day"), dates.current_season(F.col("o_orderdate")).alias("season_now"),
    )
