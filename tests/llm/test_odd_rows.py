"""Every operator on NULLs, empty and repeated rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from slabmill.llm import decontam, kneser_ney, language_model, line_dedup, quality_rules, sharding, url_filter

PROSE = "It was a bright cold day in April and the clocks were striking thirteen when the man came slowly up the stairs of the old house"
LINE = "This very line stands in a great many documents of this small table."
DOCS = [
    (1, f"{PROSE}\n{LINE}", "en"), (2, f"  {LINE.upper()} \n{LINE}\n{PROSE} and more", "en"), (3, LINE, "de"), (4, f"\n\n{LINE}\n", None), (5, f"{LINE}\nlast", "fr"),
    (6, LINE, "en"), (6, LINE, "en"), (None, LINE, "en"), (None, None, None), (7, "", "es"), (8, None, "en"), (9, "word " * 30_000, "en"), (10, "*** ### $$$ " * 30, "en"),
    (11, PROSE, "en"), (11, PROSE, "en"), (12, PROSE.upper() + "!!", "en"), (13, "a\tb c\x0bd", "en"), (14, "é ß Σ日本 🙂", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "row", 1, 2, True) for r in DOCS]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, size int, hits int, kept boolean")
    return frame.withColumnRenamed("key", "bucket").repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, bucket string, size int")


def lower(text: bytes) -> bytes:
    return text.lower()


def test_url_filter(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("b.example.net/en/x", "block"), ("org/", "allow"), ("org/", "block"), ("a.com/1/", "allow"), ("com/1/23", "block")]
    urls = [
        None, "", "no scheme", "http://", "http://NET", "http://x.net/", "http://net/?q", "http://x.example.NET/en/x", "http://b.example.net/en/xy", "http://c.b.example.net/en/x#z",
        "http://notnet/", "http://.net/", "http://net./", "a://b://c.org/", "http://a.org\n/p", "http://org/p?x/y", "http://a.com/1/234", "http://b.com/1/234", "http://x.net/", "http://" + "a." * 3000 + "net/" + "p" * 5000,
    ]
    pages = spark.createDataFrame([(i if i % 7 else None, u, "h", 0, "s") for i, u in enumerate(urls)], "page_id long, url string, host string, row int, stack string").repartition(4)
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "rule string, verdict string"))
    right = []
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        best = None
        for rule, verdict in rules:
            h, p = rule.split("/", 1)
            if ("." + host).endswith("." + h) and path.startswith("/" + p):
                best = max(best or (0,), (len(rule), len(h), verdict, rule))
        right.append((i if i % 7 else None, host, path, best and best[3], best[2] if best else "allow"))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(right, key=order)
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, "rule string, verdict string")).count() == 0
    empty = spark.createDataFrame([], "rule string, verdict string")
    assert {r["verdict"] for r in url_filter.judge_urls(pages, empty).collect()} == {"allow"}


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, shards=5).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted(((d, t) for d, t, _ in DOCS), key=repr)
    shards = defaultdict(list)
    for r in rows:
        assert r["size"] == 8 + len((r["text"] or "").encode())
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(5))
    assert sharding.shard_documents(none, shards=5).count() == 0


def test_sharding_is_even_even_with_a_hot_text(spark):
    rows = [(i, "same text" * 20 if i % 3 else f"text {i} " * (i % 50)) for i in range(3000)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=24).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in found]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 408


def test_quality_rules(spark, docs, none):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in quality_rules.judge_quality(docs).collect()}
    right = set()
    kept = {}
    for d, t, _ in DOCS:
        words = (t or "").encode().split()
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        kept[d] = not failed and d in (1, 2, 3, 4, 5, 6, None, 11)
        right.add((d, len(words), sum(len(w.decode()) for w in words), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed, kept[d]))
    assert got == right
    assert quality_rules.judge_quality(none).count() == 0


def test_repeated_words_with_many_distinct_words():
    rng = np.random.default_rng(1)
    words = [b"w%d" % i for i in rng.integers(0, 9000, 20_000)]
    words += words[500:540] + [b"x"] + words[530:536]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    right = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    assert len(set(words)) ** 5 > 1 << 63 and quality_rules.repeated_words(words) == len(right)


def test_cascade_order_does_not_change_verdicts(docs, monkeypatch):
    usual = {(r["doc_id"], r["kept"]) for r in quality_rules.judge_quality(docs).collect()}
    monkeypatch.setattr(quality_rules, "cascade_order", lambda d, rules, n, text: list(range(len(rules)))[::-1])
    assert {(r["doc_id"], r["kept"]) for r in quality_rules.judge_quality(docs).collect()} == usual


def brute_lines(rows, min_chars=40, min_docs=5):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    holders = defaultdict(set)
    for d, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(low(strip(x))) >= min_chars:
                holders[low(strip(x))].add(d)
    shared = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if low(strip(x)) not in shared or shared[low(strip(x))] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs, none):
    rows = line_dedup.dedup_lines(docs)
    assert rows.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows.collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(DOCS), key=repr) and any(g[2] for g in got)
    assert line_dedup.dedup_lines(none).count() == 0


def test_quality_classifier(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 11, 11)] + [(10, 0, 0), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = kneser_ney.classify(docs, labels).collect()
    assert len(rows) == len(DOCS) and all(r["perplexity"] > 0 for r in rows)
    assert all(r["kept"] for r in rows if not r["text"])
    assert kneser_ney.classify(none, labels).count() == 0
    assert all(r["kept"] for r in kneser_ney.classify(docs, labels.limit(0)).collect())


def test_kneser_ney_probabilities_sum_to_one_and_match_a_slow_count():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("aab "), 3000)).encode()
    alphabet = np.full(kneser_ney._CODE_POINTS + 1, kneser_ney.OTHER, np.int32)
    alphabet[[ord("a"), ord("b"), ord(" ")]] = [1, 2, 3]
    counts = np.bincount(kneser_ney.grams(text, alphabet), minlength=64**4).astype(np.int32)
    p = 10 ** kneser_ney.log_probabilities(counts).astype(np.float64)
    assert np.abs(p.reshape(-1, 64).sum(axis=1) - 1).max() < 0.02
    seen = {g: int(n) for g, n in enumerate(counts) if n}

    def slow(gram: tuple, order: int) -> float:
        if order == 0:
            return 1 / 64
        types = {}
        for g, n in seen.items():
            digits = tuple(g // 64 ** (3 - k) % 64 for k in range(4))
            if order == 4:
                types[digits] = n
            else:
                types.setdefault(digits[-order:], set()).add(digits[-order - 1 :])
        table = {k: v if isinstance(v, int) else len(v) for k, v in types.items()}
        n1, n2, n3, n4 = (max(1, sum(v == k for v in table.values())) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        cut = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.1, 0.1, 0.1], [0, 1, 2, 3])
        mine = {k: v for k, v in table.items() if k[:-1] == gram[-order:-1]}
        below = slow(gram, order - 1)
        if not mine:
            return below
        total = sum(mine.values())
        c = table.get(gram[-order:], 0)
        return max(0, c - cut[min(c, 3)]) / total + sum(cut[min(v, 3)] for v in mine.values()) / total * below

    for gram in [(1, 1, 2, 3), (3, 3, 3, 1), (0, 0, 0, 1), (2, 9, 1, 1), (1, 2, 3, 40)]:
        code = sum(s * 64 ** (3 - k) for k, s in enumerate(gram))
        assert math.isclose(p[code], slow(gram, 4), rel_tol=0.01), gram


def test_decontamination_against_every_window(spark, docs, none):
    item = PROSE.split()
    bench = spark.createDataFrame([(1, PROSE), (2, " ".join(item[:12])), (3, "too short"), (4, None), (5, " ".join(item[8:])), (5, "q " * 9), (6, "a b a b a b a b a")], "item_id long, text string")
    more = [
        (20, "x " * 40 + PROSE.lower() + " y" * 40, "en"), (21, " ".join(item[:9] + ["odd"] + item[9:]), "en"), (22, " ".join(item[:6]), "en"), (23, "a b " * 6, "en"),
        (24, " ".join([*item[4:], "end"]), "en"), (25, f"{PROSE} {PROSE}", "en"), (26, "q " * 7, "en"),
    ]
    frame = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    got = {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontam.benchmark_hits(frame, bench).collect()}
    right = set()
    for i, t in [(r["item_id"], r["text"]) for r in bench.collect()]:
        words = (t or "").lower().split()
        if len(words) < 5:
            continue
        theirs = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        for d, text, _ in DOCS + more:
            own = (text or "").lower().encode().split()
            own = [w.decode() for w in own]
            best = 0.0
            for s in range(max(1, len(own) - len(words) + 1)):
                part = own[s : s + len(words)]
                mine = Counter(tuple(part[k : k + 5]) for k in range(len(part) - 4))
                common = (mine & theirs).total()
                best = max(best, common / max(1, mine.total() + theirs.total() - common))
            if best >= 0.75:
                right.add((d, i, round(best, 9)))
    assert got == right and len(right) > 8
    assert decontam.benchmark_hits(none, bench).count() == 0 and decontam.benchmark_hits(docs, bench.limit(0)).count() == 0
    kept = decontam.with_benchmark_hits(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)  # the input's own "hits" is replaced


def test_several_indexes_find_what_one_finds(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, PROSE), (2, LINE), (3, PROSE + " indeed")], "item_id long, text string")
    whole = sorted(map(tuple, decontam.benchmark_hits(docs, bench).collect()), key=repr)
    monkeypatch.setattr(decontam, "ITEMS_PER_INDEX", 1)
    assert sorted(map(tuple, decontam.benchmark_hits(docs, bench).collect()), key=repr) == whole and whole


def test_multi_index_yields_every_fingerprint_in_the_radius():
    rng = np.random.default_rng(2)
    index = decontam.BenchmarkIndex([(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 30))) for i in range(40)])
    for i in range(40):
        for flips in (0, 20, decontam.RADIUS, decontam.RADIUS + 1):
            bits = np.unpackbits(index.prints[i])
            bits[rng.choice(decontam.BITS, flips, replace=False)] ^= 1
            assert (i in index.within_radius(np.packbits(bits))) == (flips <= decontam.RADIUS)


def test_language_model_base_scores(docs, none):
    rows = language_model.score_texts(docs).collect()
    counts = Counter()
    texts = []
    for d, t, _ in DOCS:
        words = [*lower((t or "").encode()).split(), b"\n"]
        texts.append((d, words))
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            counts.update(words)
    n, v = counts.total(), len(counts)
    right = sorted((repr(d), len(w), sum(x in counts for x in w), round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for d, w in texts)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows) == right
    assert {r["train_tokens"] for r in rows} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert language_model.score_texts(none).count() == 0


def test_language_model_with_few_held_words_gives_the_same(docs, monkeypatch):
    whole = sorted((repr(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in language_model.score_texts(docs).collect())
    monkeypatch.setattr(language_model, "HELD_BYTES", 4)
    some = sorted((repr(r["doc_id"]), r["n_known"], round(r["base_score"], 6)) for r in language_model.score_texts(docs).collect())
    assert some == [w[:3] for w in whole]


def test_log_bilinear_model_learns_a_pattern_and_is_normalised():
    log_noise = np.log(np.full(language_model.CLASSES, 1 / language_model.CLASSES))
    codes = np.array([(a << 16) | (b << 8) | (b % 7 + 1) for a in range(1, 60) for b in range(1, 60)])
    p = start = language_model.Parameters.fresh(log_noise)
    for r in range(40):
        p = language_model.train_nce(p, codes, np.ones(len(codes), np.int64), log_noise, r)
    table = p.log10_table()
    assert np.abs((10.0 ** table.astype(np.float64)).sum(axis=1) - 1).max() < 1e-4
    gain = table[codes >> 8, codes & 255].mean() - start.log10_table()[codes >> 8, codes & 255].mean()
    assert gain > 0.5


def test_sha256_digest_of_kept_lines(docs):
    from pyspark.sql import functions as F

    got = {r[0] for r in line_dedup.dedup_lines(docs).select(F.sha2("text", 256)).collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest() for *_, t in brute_lines(DOCS)}
