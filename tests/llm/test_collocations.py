"""Collocations against brute force over all phrases."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from slabmill.llm import collocations as co

ODD = [
    ("en", "New York is New York. New\tYork,new york!  NEW  YORK\x0bnew\nyork new york"), ("en", None), (None, "le chat noir le chat noir le chat gris"), ("und", "le chat noir"), ("de", ""), ("de", "..,,;;  \t "),
    ("de", "größe é É größe é É größe é É   x y \x00 nul \x00 nul"), ("en", "new york is new york. " * 3000), ("en", "a a a a a a a a"), ("en", "a a a a a a a a"), ("fr", "日本 語 日本 語 日本 語"),
]


def brute(rows, least, first, share):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + m]) for m in (1, 2, 3, 4) for i in range(len(words) - m + 1))
    frequent = {p: n for p, n in counts.items() if len(p) > 2 and n >= least}
    inside = Counter()
    for (lang, *p), n in frequent.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[(lang, *p[i : i + m])] = max(inside[(lang, *p[i : i + m])], n)
    out = []
    for (lang, *p), a in frequent.items():
        if 100 * inside[(lang, *p)] >= share * a:
            continue
        score, k = min((2_000_000 * a // (counts[(lang, *p[:k])] + counts[(lang, *p[k:])]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), counts[(lang, *p[:k])], counts[(lang, *p[k:])]))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= first:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(rows)


def frame(spark, rows):
    return spark.createDataFrame([(t, la, 1, "w", 2) for la, t in rows], "text string, lang string, m int, word string, h1 int").repartition(3)


def spark_rows(df):
    return sorted(map(tuple, df.collect()))


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    for least, first, share in ((1, 2000, 80), (2, 3, 80), (2, 2000, 101), (30, 2000, 50)):
        assert spark_rows(co.collocations(docs, least, first, share)) == brute(ODD, least, first, share) != []
    assert co.collocations(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    return [(str(rng.choice(["en", "de"])), " ".join(words[min(59, int(rng.exponential(6)))] + str(rng.choice(["", "", "", "", "."])) for _ in range(400))) for _ in range(60)]


def test_spills_bursts_and_new_numbers(spark, prose, monkeypatch):
    right = brute(prose, 4, 50, 80)
    monkeypatch.setattr(co, "HELD_WORDS", 50)
    monkeypatch.setattr(co, "LEAST_FILTER", 3)
    monkeypatch.setattr(co, "MOST_FILTER", 6)
    monkeypatch.setattr(co, "_SLICE_BITS", 4)
    small = co.HatTrie
    monkeypatch.setattr(co, "HatTrie", lambda: small(40, 8))
    monkeypatch.setattr(co, "slices", lambda batches, s=co.slices: s(batches, size=2000))
    assert spark_rows(co.collocations(frame(spark, prose), 4, 50)) == right


def test_trie_counts_like_a_table():
    rng = np.random.default_rng(6)
    trie, right, out = co.HatTrie(300, 16), Counter(), Counter()
    for _ in range(50):
        paths = np.sort(rng.integers(0, 30, 200) ** 2 // 9 << 32 | rng.integers(0, 40, 200))
        right.update(paths.tolist())
        trie.add(paths)
        assert trie.size == sum(map(len, trie._containers)) and trie._borders == sorted(trie._borders)
        if trie.full:
            for keys, counts in trie.spill():
                out.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
            assert trie.size <= 150
    assert len(trie._containers) > 3
    for keys, counts in trie.spill(everything=True):
        out.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert out == right and trie.size == 0


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    phrases = spark.createDataFrame([(2, 1, 2, 0, 0, big)], "m int, h1 long, h2 long, h3 long, h4 long, n long")
    counts = phrases.union(spark.createDataFrame([(1, 1, 0, 0, 0, big + 1), (1, 2, 0, 0, 0, big + 7)], phrases.schema))
    (row,) = co._cut_scores(phrases, counts).collect()
    assert (row["l"], row["r"], row["score"]) == (big + 1, big + 7, 2_000_000 * big // (2 * big + 8))
