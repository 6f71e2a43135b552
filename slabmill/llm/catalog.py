"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabmill.llm import collocations, decontam, kneser_ney, language_model, line_dedup, ngram_join, packing, quality_rules, sharding, spelling, token_counts, token_files, url_filter
from slabmill.llm.common import table
from slabmill.llm.tokens import public_tokenizer
from slabmill.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return register


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

_URL_SQL = r"""
with cut as (
    select page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') as raw_host,
           coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path
    from pages
), parts as (
    select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from cut
), judged as (
    select *, case
        when ends_with('.' || host, '.example.net') and starts_with(path, '/en/') then 'example.net/en/'
        when ends_with('.' || host, '.example.com') and starts_with(path, '/de/') then 'example.com/de/'
        when ends_with('.' || host, '.org') and starts_with(path, '/fr/') then 'org/fr/'
        when ends_with('.' || host, '.net') and starts_with(path, '/') then 'net/'
    end as rule
    from parts
)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from judged
"""


@query("op1_url_filters", _URL_SQL)
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


@query("op2_sharding")
def sharded(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, folder, "documents"), shards=24)
    crc = F.crc32(F.col("text").cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_RULES_SQL = r"""
with docs as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), counted as (
    select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from docs
), placed as (
    select r, unnest(range(1, len(words) - 3)) as i, words from counted where len(words) >= 5
), windows as (
    select r, i, array_to_string(list_slice(words, i, i + 4), ' ') as five from placed
), twice as (
    select r, i from windows qualify count(*) over (partition by r, five) > 1
), covered as (
    select r, count(distinct i + k) as n from twice, range(0, 5) t(k) group by r
), measured as (
    select c.r, doc_id, text, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
           len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(lines) as n_lines,
           length(text) - length(replace(text, '!', '')) as n_marks,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) as n_lower,
           length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) as n_digits,
           len(list_filter(list_zip(words, words[2:]), lambda x: x[1] = x[2])) as n_stutters
    from counted c left join covered v on v.r = c.r
), judged as (
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
           10 * n_symbols > n_words or 10 * n_marks > 2 * n_words or 10 * n_upper > 4 * (n_upper + n_lower) or 10 * n_dup_lines > 5 * n_lines
           or 10 * n_stutters > 2 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_digits > 5 * word_chars as rejected
    from measured
)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and not rejected as kept
from judged
"""


@query("op3_quality_rules", _RULES_SQL)
def quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, folder, "documents")).drop("rejected_by")


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, folder, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=1, remember=80 << 20)
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op5_token_files")
def token_id_files(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), place, public_tokenizer("byte_bpe_50k.json"), end_id=2, vocabulary=50_257, remember=96 << 20)
    return token_files.read_token_files(spark, place).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_LINE_SQL = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as position
    from documents
), keyed as (
    select doc_id, position, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), shared as (
    select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
    select k.doc_id, k.position, k.line, s.key is not null and k.doc_id <> s.keeper as gone from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by position) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


@query("op6_line_dedup", _LINE_SQL)
def lines_deduped(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_quality_classifier")
def quality_classified(spark: SparkSession, folder: str) -> DataFrame:
    judged = kneser_ney.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "lang", F.col("n_chars_scored").alias("n_chars"), "perplexity", "low", "high", "kept")


@query("op10_decontamination")
def benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_lm_scoring")
def language_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(table(spark, folder, "documents"))


_NEAR_SQL = r"""
with recursive worded as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
    from documents
), placed as (
    select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from worded where len(words) > 0
), shingles as (
    select distinct doc_id, array_to_string(list_slice(words, i, i + 4), ' ') as shingle from placed
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), common as (
    select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), links as (
    select x, y from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)
), reached as (
    select x as doc_id, y as other from links union select r.doc_id, l.y from reached r join links l on l.x = r.other
), least as (
    select doc_id, min(other) as other from reached group by doc_id
)
select w.doc_id, coalesce(n, 0) as n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) as component_id
from worded w left join sizes s on s.doc_id = w.doc_id left join least l on l.doc_id = w.doc_id
"""


@query("op8_ngram_jaccard_join", _NEAR_SQL)
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_copy_groups(table(spark, folder, "documents"))


@query("op11_token_counts")
def counted_tokens(spark: SparkSession, folder: str) -> DataFrame:
    cache = scratch_path(spark, "token-counts")
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizer("byte_bpe_50k.json"), cache, limit=1024)


_SPELLING_SQL = r"""
with recursive crc_table as (
    select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as cells
    from (select unnest(range(256)) as i)
), runs as (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run
    from documents
), counted as (
    select doc_id, run, count(*) as n from runs where length(run) >= 6 group by doc_id, run
), written as (
    select doc_id, run, n, flatten(list_transform(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: unicode(c)),
           lambda u: case when u < 128 then [u::bigint] else [195::bigint, (u - 64)::bigint] end)) as bytes
    from counted
), hashed as (
    select run, n, xor(list_reduce(list_concat([4294967295::bigint], bytes), lambda c, b: xor(c >> 8, cells[1 + xor(c & 255, b)])), 4294967295) as h
    from written, crc_table
), spoilt as (
    select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed
), words as (
    select word, sum(n)::bigint as n from spoilt where length(word) >= 6 group by word having sum(n) >= 5
), gaps as (
    select word, n, length(word) as size, unnest(range(length(word))) as i from words
), cuts as (
    select word, n, size, i, left(word, i::int) || substr(word, i::int + 2) as cut from gaps
), pairs as (
    select a.word, b.word as near from cuts a join cuts b on a.cut = b.cut and a.i = b.i and a.size = b.size and a.word <> b.word
    union select c.word, w.word from cuts c join words w on c.cut = w.word
    union select w.word, c.word from cuts c join words w on c.cut = w.word
), best as (
    select p.word, count(*) as n_near, min(struct_pack(less := -w.n, word := p.near)) as top from pairs p join words w on w.word = p.near group by p.word
), judged as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when -top.less >= 5 * w.n then top.word end as form, case when -top.less >= 5 * w.n then -top.less end as form_n
    from words w left join best b on b.word = w.word
), led as (
    select word, word as reached, 0 as steps from judged union all select l.word, j.form, steps + 1 from led l join judged j on j.word = l.reached where j.form is not null
)
select j.word, j.form, r.root, j.n, j.n_near, j.form_n from judged j join (select word, arg_max(reached, steps) as root from led group by word) r on r.word = j.word
"""


@query("op12_spelling_variants", _SPELLING_SQL)
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


_PHRASE_SQL = r"""
with pieces as (
    select d, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece
    from (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)
), worded as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces
), totals as (
    select lang, sum(len(words))::bigint as n from worded group by lang
), sizes as (
    select unnest([1, 2, 3, 4]) as m
), tokens as (
    select p, lang, unnest(words) as w, unnest(range(len(words))) as i from (select row_number() over () as p, * from worded)
), windows as (
    select lang, w, w || ' ' || lead(w, 1) over q as w2, w || ' ' || lead(w, 1) over q || ' ' || lead(w, 2) over q as w3,
           w || ' ' || lead(w, 1) over q || ' ' || lead(w, 2) over q || ' ' || lead(w, 3) over q as w4
    from tokens window q as (partition by p order by i)
), runs as (
    select lang, 1 as m, w as phrase from windows union all select lang, 2, w2 from windows union all select lang, 3, w3 from windows union all select lang, 4, w4 from windows
), spelt as (
    select lang, m, phrase, count(*) as f from runs where phrase is not null group by all having count(*) >= 30
), counts as (
    select lang, m, string_split(phrase, ' ') as run, f from spelt
), cuts as (
    select c.lang, c.m, c.run, c.f, k from counts c, (select unnest([1, 2, 3]) as k) where c.m >= 2 and k < c.m
), scored as (
    select c.lang, c.m, c.run, c.f as a, k, l.f as l, r.f as r, (2000000::hugeint * c.f) // (l.f::hugeint + r.f) as score
    from cuts c join counts l on l.lang = c.lang and l.m = k and l.run = list_slice(c.run, 1, k)
    join counts r on r.lang = c.lang and r.m = c.m - k and r.run = list_slice(c.run, k + 1, c.m)
), lowest as (
    select * from scored qualify row_number() over (partition by lang, m, run order by score, k) = 1
), inner_runs as (
    select lang, s.m, list_slice(run, i, i + s.m - 1) as run, max(f) as around
    from (select lang, c.m as whole, run, f, s.m, unnest(range(1, c.m - s.m + 2)) as i from counts c join sizes s on s.m >= 2 and s.m < c.m) s group by all
), kept as (
    select w.* from lowest w left join inner_runs i on i.lang = w.lang and i.m = w.m and i.run = w.run where around is null or 100::hugeint * around < 80::hugeint * a
), ranked as (
    select lang, array_to_string(run, ' ') as phrase, a, l, r, score::bigint as score,
           row_number() over (partition by lang order by score desc, a desc, array_to_string(run, ' ')) as rank
    from kept
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


@query("op13_phrase_collocations", _PHRASE_SQL)
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
