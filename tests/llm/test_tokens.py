"""Packing and token files against whole-text encoding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from slabmill.llm import packing, token_files
from slabmill.llm.tokens import BYTE_LEVEL, WHITESPACE, ChunkEncoder, public_tokenizer

ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a \n b\n\n", "\ta\r\n b", "don't DON'T 'll", "x  y", "x  y", "a b c", "\x1c \x1f.", "!!\x1d !!",
    "<|endoftext|> <|startoftext|>", "Ångström é ́x", "Σίσυφος ΣΑΣ", "日本語 テキスト", "🙂🙂 🙂", "1234 56.7%", "--- |||", "…", "ſ İ", "a" * 5000, "ab " * 3000,
]


def random_text(rng: random.Random) -> str:
    alphabet = "aB1.,'\n\t   \r\x0b\x0c\x1c\x85  éßΣ🙂́​"
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", BYTE_LEVEL), ("word_bpe_49k.json", WHITESPACE)])
@pytest.mark.parametrize("remember", [600_000, 3])
def test_chunks_give_the_ids_of_the_whole_text(name, kind, remember):
    rng = random.Random(5)
    texts = ODD + [random_text(rng) for _ in range(1500)]
    whole = Tokenizer.from_file(public_tokenizer(name))
    whole.encode_special_tokens = True
    made = ChunkEncoder(public_tokenizer(name), kind, remember=remember).encode([t.encode() for t in texts])
    for text, ids, right in zip(texts, made, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == right.ids, repr(text)


ROWS = [(3, "one two three"), (1, None), (1, ""), (None, "no key"), (3, "one two three"), (7, "word " * 9000), (5, "x")]


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame([(k, t, "other") for k, t in ROWS], "doc_id long, text string, start string").repartition(3)


def ids_of(name, text, end):
    whole = Tokenizer.from_file(public_tokenizer(name))
    whole.encode_special_tokens = True
    return [*whole.encode(text or "", add_special_tokens=False).ids, end]


def test_packing_places_every_piece_without_gaps(spark, odd_docs):
    rows = packing.pack_documents(odd_docs, public_tokenizer("word_bpe_49k.json"), 1, capacity=512).collect()
    left = sorted((k if k is not None else -1, tuple(ids_of("word_bpe_49k.json", t, 1))) for k, t in ROWS)
    whole: dict = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["length"] == len(r["ids"]) // 4 <= 512 and r["start"] == r["piece"] * 512
        whole.setdefault((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"]), []).append(np.frombuffer(r["ids"], "<u4").tolist())
    tokens = sorted(x for parts in whole.values() for p in parts for x in p)
    assert tokens == sorted(x for _, ids in left for x in ids)
    assert [i for p in sorted(k for k in whole if k[0] == 7) for i in whole[p][0]] == ids_of("word_bpe_49k.json", ROWS[5][1], 1)
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512


def test_packing_of_no_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), public_tokenizer("word_bpe_49k.json"), 1).count() == 0


def test_sums_of_squares_come_close_to_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 8000).astype(int) + 1)
    bins, offsets = packing.sum_of_squares(lengths)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 4096 and len(fill) <= 1.01 * np.ceil(lengths.sum() / 4096)
    for b in range(0, len(fill), 50):
        mine = np.flatnonzero(bins == b)
        order = mine[np.argsort(offsets[mine])]
        assert offsets[order].tolist() == [0, *np.cumsum(lengths[order])[:-1].tolist()]


def test_token_files_round_trip(spark, odd_docs, tmp_path):
    place = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(odd_docs, place, public_tokenizer("byte_bpe_50k.json"), 2, 50_257)
    rows = sorted(token_files.read_token_files(spark, place).collect(), key=lambda r: (r["start"], r["n_tokens"]))
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 3, 3, 5, 7]
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    assert start == sum(p["tokens"] for p in manifest["parts"])
    right = sorted((k if k is not None else -1, tuple(ids_of("byte_bpe_50k.json", t, 2))) for k, t in ROWS)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == right
    assert manifest["dtype"] == "<u2" and zlib.crc32(rows[0]["ids"]) == token_files.crc32_of_ids(np.frombuffer(rows[0]["ids"], "<u4"))


def test_token_files_of_no_rows(spark, tmp_path):
    place = f"file://{tmp_path}/none"
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), place, public_tokenizer("byte_bpe_50k.json"), 2, 50_257)
    assert token_files.read_token_files(spark, place).count() == 0


def test_encoding_is_not_interrupted_by_the_cycle_collector():
    import gc

    begun = []
    encode = ChunkEncoder(public_tokenizer("byte_bpe_50k.json"), BYTE_LEVEL).encode
    texts = [" ".join(f"w{i}x{k}" for k in range(400)).encode() for i in range(40)]
    note = lambda phase, info: begun.append(phase)
    gc.callbacks.append(note)
    try:
        encode(texts)
    finally:
        gc.callbacks.remove(note)
    assert begun == [] and gc.isenabled()


def test_packing_does_not_hang_on_the_encoders_memory(spark):
    texts = [(i, " ".join(f"w{i % 50}x{k}" for k in range(i % 97 * 20))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2, "doc_id")
    path = public_tokenizer("word_bpe_49k.json")
    rows = lambda **bounds: sorted((r.doc_id, r.piece, r.start, r.ids, r.sequence_id, r.offset) for r in packing.pack_documents(docs, path, 1, **bounds).collect())
    assert rows(remember=1 << 16, cut=1 << 14) == rows()


def test_token_files_do_not_hang_on_the_encoders_memory(spark, odd_docs, tmp_path):
    def rows(name: str, **bounds):
        place = f"file://{tmp_path}/{name}"
        token_files.write_token_files(odd_docs, place, public_tokenizer("byte_bpe_50k.json"), 2, 50_257, **bounds)
        return sorted((r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read_token_files(spark, place).collect())

    assert rows("little", remember=1 << 10) == rows("much", remember=96 << 20) == rows("default")
