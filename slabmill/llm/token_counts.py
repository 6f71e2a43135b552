"""Token counts behind a digest cache: every distinct text is encoded once for each version of a tokenizer."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slabmill.llm.common import ascii_lower, slices, small_batches
from slabmill.llm.tokens import BYTE_LEVEL, WHITESPACE, ChunkEncoder
from slabmill.session import is_stored, stage

CACHE = "tokenizer string, digest binary, n_tokens long"
#: Up to so many missing digests (33 bytes each) are sent to all tasks to pick their texts; more are met by a shuffle.
SENT_DIGESTS = 200_000
_COUNTED = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


def tokenizer_version(path: str) -> str:
    """What a count depends on: the library and its version, and the tokenizer's whole file."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        held = file.read()
    return hashlib.sha256(f"{library} {__import__(library).__version__}\n".encode() + held).hexdigest()


def _read(path: str) -> dict:
    if path.endswith(".model"):
        return {}
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def _kinds(step: dict | None) -> list[str]:
    """The types of a normaliser's or pre-tokenizer's steps."""
    steps = (step or {}).get("normalizers") or (step or {}).get("pretokenizers") or ([step] if step else [])
    return [s["type"] for s in steps]


def _signs(spec: dict) -> list[str]:
    """For each string that the tokenizer takes as one token, signs in it that no normaliser makes of other characters; all of it where it has none."""
    return [(re.findall(r"[!-,\-./:<-@\[-_{-~]+", t["content"]) or [t["content"]])[0] for t in spec.get("added_tokens", [])]


def normalised(text: Column, path: str) -> Column:
    """The text as far as the tokenizer tells texts apart, NULL as the empty text.

    For a tokenizer that lower-cases and drops white space: A-Z lower-cased and runs of ``[\\x20\\x09-\\x0D]`` made one space, except in
    texts that may hold one of its special strings, which are matched before. For all others: the text itself.
    """
    whole, spec = F.coalesce(text, F.lit("")), _read(path)
    if {"Lowercase", "Replace"} <= set(_kinds(spec.get("normalizer"))) and _chunks_by(spec) == WHITESPACE:
        folded = F.regexp_replace(ascii_lower(whole), "[ \\t-\\r]+", " ")
        for sign in _signs(spec):
            folded = F.when(F.contains(whole, F.lit(sign)), whole).otherwise(folded)
        return folded
    return whole


def _chunks_by(spec: dict) -> str | None:
    """How texts of a tokenizer may be cut into chunks that are encoded once; None where nothing is known."""
    if spec.get("model", {}).get("type") != "BPE" or any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
        return None
    before = _kinds(spec.get("pre_tokenizer"))
    if before == ["ByteLevel"] and spec.get("normalizer") is None and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"].get("add_prefix_space"):
        return BYTE_LEVEL
    if before == ["Split", "ByteLevel"] and spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] == "Removed" and "Replace" in _kinds(spec.get("normalizer")):
        return WHITESPACE
    return None


def counter(path: str) -> Callable[[list[bytes]], list[int]]:
    """A function from UTF-8 texts to their numbers of tokens, as the library counts them by default (nothing added, nothing cut off)."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode([t.decode() for t in texts], num_threads=1)]
    spec = _read(path)
    kind, signs = _chunks_by(spec), [s.encode() for s in _signs(spec)]
    chunks = ChunkEncoder(path, kind) if kind else None
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()

    def count(texts: list[bytes]) -> list[int]:
        plain = [chunks is not None and not any(s in t for s in signs) for t in texts]
        found = iter(chunks.count([t for t, p in zip(texts, plain, strict=True) if p])) if chunks else iter(())
        return [next(found) if p else len(whole.encode(t.decode(), add_special_tokens=False).ids) for t, p in zip(texts, plain, strict=True)]

    return count


_COUNTERS: dict[str, Callable[[list[bytes]], list[int]]] = {}


def _counted(path: str, version: str):
    def count(batches):
        if version not in _COUNTERS:  # later tasks of a Python worker go on with its memory
            _COUNTERS[version] = counter(path)
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_COUNTERS[version](texts), pa.int64())], schema=_COUNTED)

    return count


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``digest`` and ``n_tokens`` of one version; one row a digest, also where two runs stored the same."""
    if not is_stored(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    held = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``cache`` is a folder that all executors reach; it is made where there is none. It holds (tokenizer version, digest, count), the digest
    being SHA-256 of the ``normalised`` text. Digests of the rows are met with the stored ones; of what is missing, each distinct text is encoded
    once, by whichever task has it, and appended to the cache before it is read again: a second call encodes nothing, a call stopped by a lost
    executor leaves whole entries or none, and one with a new tokenizer file or library version starts its own entries.

    NULL texts are empty (0 tokens, 0 bytes); NULL and repeated keys keep a row each; an empty table gives no rows; a very long text
    is encoded whole, by itself; other columns are not read. Copies, however many, are summed up before their text is shuffled;
    a digest that a third of the rows share is a skewed join side, which Spark splits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_version(tokenizer_path)
    folded = normalised(F.col(text), tokenizer_path)
    digest = F.unhex(F.sha2(folded, 256)).alias("digest")
    rows = stage(docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), digest), "digests")
    missing = stage(rows.select("digest").distinct().join(stored_counts(spark, cache, version), "digest", "left_anti"), "missing")
    n = missing.count()
    if n:
        texts = docs.select(digest, F.coalesce(F.col(text), F.lit("")).alias("text"))
        if n <= SENT_DIGESTS:
            wanted = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            wanted = texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
        found = wanted.mapInArrow(_counted(tokenizer_path, version), "digest binary, n_tokens long")
        found.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = rows.join(stored_counts(spark, cache, version), "digest")
    return counts.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
