"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from slabmill.llm import spelling

TEXTS = [
    (1, "harbour harbour harbour harbour harbour harbour harbour harbour harbour harbour, harbor harbor"), (2, "Harbour HARBOUR harbours harbours Ärger ärger ÄRGER äRGER ärgere ärgere ärgere"),
    (2, "Harbour HARBOUR harbours harbours Ärger ärger ÄRGER äRGER ärgere ärgere ärgere"), (None, None), (3, ""), (None, "harbour_harbouz harbouz×harbour÷ 日本harbour"), (4, "x" * 700 + " " + "x" * 699 + "y " + "x" * 700),
    (5, "listen silent enlist tinsel inlets " * 3), (6, "listen silent lister " * 40 + "listenz"), (7, "ﬁnger fingers finger finger"), (8, "word " * 20_000 + "wording " * 5),
]


def brute(rows, least_letters, least_count, ratio, spoilt):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % spoilt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}

    def near(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        if len(x) > len(y):
            x, y = y, x
        return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    found = {w: sorted((-words[v], v) for v in words if v != w and near(w, v)) for w in words}
    form = {w: f[0][1] if f and -f[0][0] >= ratio * words[w] else None for w, f in found.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(found[w]), words.get(form[w])))
    return sorted(out)


def spark_rows(df):
    return sorted(map(tuple, df.collect()))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, 1, "w", "r") for k, t in TEXTS], "doc_id long, text string, n int, word string, root string").repartition(3)
    for least, count, ratio, spoilt in ((6, 1, 2, 3), (1, 1, 5, 199), (6, 2, 2, 1 << 40), (5, 1, 3, 1)):
        assert spark_rows(spelling.spelling_variants(docs, least, count, ratio, spoilt)) == brute(TEXTS, least, count, ratio, spoilt) != []
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert {r.word: r.root for r in spelling.spelling_variants(docs, 6, 1, 2, 1 << 40).collect()}["harbours"] == "harbour"


@pytest.fixture(scope="module")
def invented():
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("aeinrstäß"), rng.integers(4, 9))) for _ in range(500)]
    rows = []
    for i in range(60):
        words = [base[int(abs(rng.normal(0, 120))) % 500] for _ in range(200)]
        words = [w if rng.random() < 0.9 else w[: (p := rng.integers(len(w)))] + str(rng.choice(list("aein"))) + w[p + rng.integers(2) :] for w in words]
        rows.append((i, " ".join(words)))
    return rows


def test_many_leaves_and_buckets(spark, invented, monkeypatch):
    right = brute(invented, 4, 1, 3, 50)
    docs = spark.createDataFrame(invented, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(spelling, "LEAF_WORDS", 20)
    monkeypatch.setattr(spelling, "BUCKET", 4)
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 50)
    assert spark_rows(spelling.spelling_variants(docs, 4, 1, 3, 50)) == right
    monkeypatch.setattr(spelling, "SAMPLED_WORDS", 100)
    assert spark_rows(spelling.spelling_variants(docs, 4, 1, 3, 50)) == right


def test_words_alike_in_their_letters_are_dealt_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = {"".join(rng.permutation(list("aabbccdd"))) for _ in range(300)} | {"".join(rng.permutation(list("aabbccde"))) for _ in range(300)}
    rows = [(1, " ".join(sorted(words)))]
    monkeypatch.setattr(spelling, "LEAF_WORDS", 16)
    assert spark_rows(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), 6, 1, 2, 1 << 40)) == brute(rows, 6, 1, 2, 1 << 40)


def test_chains_lead_to_the_last_form(spark):
    words = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    forms = spark.createDataFrame(list(zip(words, words[1:], strict=False)), "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, words[-1]) for w in words[:-1]}
