"""Token counts behind the digest cache, against the libraries themselves."""

from __future__ import annotations

import pytest

from slabmill.llm import token_counts
from slabmill.llm.tokens import public_tokenizer

TEXTS = [
    None, "", " ", "\n\n", "plain words, here. And there!", "plain words, here. And there!", "PLAIN  words,\there. and there!", "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", "<|startoftext|> x",
    "schöne Grüße — ¿qué? 日本語 🙂 ​zero", "tab\tand\r\nline\x0b\x0c ends  ", "12345 3rd 'twas don't", "x" * 3000, "word and words " * 20_000, "á K İ İ", "nul \x00 byte",
]


def right(name, texts):
    path = public_tokenizer(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(sp.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    return [len(tk.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 6 else None, t, "x", b"d", 7) for i, t in enumerate(TEXTS)] + [(5, TEXTS[4], "x", b"d", 7)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, tokenizer string, digest binary, n_tokens int").repartition(3).persist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("sent", [0, 1000])
def test_counts_are_those_of_the_library(docs, tmp_path, monkeypatch, name, sent):
    monkeypatch.setattr(token_counts, "SENT_DIGESTS", sent)
    path = public_tokenizer(name)
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, path, str(tmp_path / "c"), limit=10).collect()), key=repr)
    texts = [*TEXTS, TEXTS[4], TEXTS[4]]
    keys = [*(i if i % 6 else None for i in range(len(TEXTS))), 5, 5]
    assert got == sorted(((k, len((t or "").encode()), n, n > 10) for k, t, n in zip(keys, texts, right(name, texts), strict=True)), key=repr)


def test_only_distinct_misses_are_encoded_and_the_cache_grows(spark, docs, tmp_path, monkeypatch):
    path, cache = public_tokenizer("word_bpe_49k.json"), str(tmp_path / "cache")
    monkeypatch.setattr(token_counts, "SENT_DIGESTS", 0)
    first = token_counts.count_tokens(docs.where("length(text) < 100"), path, cache).collect()
    stored = spark.read.parquet(cache)
    held = stored.count()
    # Two of the texts differ in case and white space only, which this tokenizer doesn't see.
    assert held == stored.select("digest").distinct().count() == len({t for t in TEXTS if t is not None and len(t) < 100}) - 2
    token_counts.count_tokens(docs, path, cache).collect()
    assert spark.read.parquet(cache).count() == held + 2
    # A stored count is used as it is; another version has its own entries.
    monkeypatch.setattr(token_counts, "counter", lambda path: pytest.fail("nothing is missing"))
    assert sorted(map(tuple, token_counts.count_tokens(docs.where("length(text) < 100"), path, cache).collect()), key=repr) == sorted(map(tuple, first), key=repr)
    monkeypatch.undo()
    monkeypatch.setattr(token_counts, "tokenizer_version", lambda path: "other")
    token_counts.count_tokens(docs, path, cache).collect()
    assert {r[0]: r[1] for r in spark.read.parquet(cache).groupBy("tokenizer").count().collect()}["other"] == spark.read.parquet(cache).where("tokenizer = 'other'").select("digest").distinct().count()


def test_twice_stored_digests_count_once(spark, docs, tmp_path):
    path, cache = public_tokenizer("byte_bpe_50k.json"), str(tmp_path / "cache")
    n = token_counts.count_tokens(docs, path, cache).count()
    spark.read.parquet(cache).select("tokenizer", "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert token_counts.count_tokens(docs, path, cache).count() == n == docs.count()


def test_empty_table(docs, tmp_path):
    assert token_counts.count_tokens(docs.limit(0), public_tokenizer("byte_bpe_50k.json"), str(tmp_path / "c")).count() == 0
