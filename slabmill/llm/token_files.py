"""Token-ID / binary output: flat files of unsigned ids with 64-bit offsets, and reading them back.

A dataset is a folder with, for each part in ascending key order,

* ``part-NNNNN.bin``: the ids of its documents one after another, little-endian unsigned 16 or 32 bit;
* ``part-NNNNN.idx``: little-endian signed 64-bit values: the number of documents ``n``, ``n + 1`` offsets into the part
  in ids, ``n`` keys, and ``n`` flags (1 where the key is present, 0 where it is NULL);

and ``manifest.json``: the id width and for each part its documents, its ids and the prefix sums of both over earlier parts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabmill.llm.common import shuffle_partitions, slices, small_batches, sparing
from slabmill.llm.tokens import BYTE_LEVEL, CUT_BYTES, REMEMBERED_BYTES, encoder

MANIFEST = "manifest.json"
WIDTHS = {2: "<u2", 4: "<u4"}
_PART = pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write_part(folder: str, part: int, attempt: int, batches: Iterator[pa.RecordBatch], tokenizer_path: str, kind: str, end_id: int, dtype: str, remember: int) -> tuple[int, int]:
    store, root = _store(folder)
    end, width, encode = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize, encoder(tokenizer_path, kind, dtype, remember).encode
    lengths, keys, flags = [], [], []
    draft = f"{root}/.part-{part:05d}-{attempt}"
    with store.open_output_stream(f"{draft}.bin") as out:
        for batch, texts in slices(batches, size=CUT_BYTES):
            column = batch.column(0)
            keys.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            flags.append(column.is_valid().to_numpy(zero_copy_only=False).astype("<i8"))
            ids = [x + end for x in encode(texts)]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)) // width)
            out.write(b"".join(ids))
    none = np.zeros(0, "<i8")
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([none, *lengths]))])
    n = len(offsets) - 1
    with store.open_output_stream(f"{draft}.idx") as out:
        for values in ([n], offsets, np.concatenate([none, *keys]), np.concatenate([none, *flags])):
            out.write(np.asarray(values, "<i8").tobytes())
    for kind_of in ("bin", "idx"):  # a second attempt at this part writes the same bytes
        store.move(f"{draft}.{kind_of}", f"{root}/part-{part:05d}.{kind_of}")
    return n, int(offsets[-1])


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, vocabulary: int, key: str = "doc_id", text: str = "text", kind: str = BYTE_LEVEL, remember: int = REMEMBERED_BYTES,
) -> dict:
    """Encode every text, append ``end_id`` and write the dataset in ascending key order; returns the manifest.

    Rows are dealt once by ranges of (key, text hash), so a repeated key is spread too, and each task streams its sorted
    rows to its own files, renamed when complete: a lost or repeated task leaves no half part. The driver sees three
    numbers a part. NULL keys come first; a NULL text is empty (its end id only); other columns are not read.
    ``remember`` bounds the encoder's memory of chunks and changes no result. ``folder`` may be any address that pyarrow's file systems open.
    """
    small_batches(docs.sparkSession)
    dtype = WIDTHS[2 if max(vocabulary - 1, end_id) < 1 << 16 else 4]
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches):
        task = TaskContext.get()
        part = task.partitionId()
        n, tokens = _write_part(folder, part, task.taskAttemptId(), batches, tokenizer_path, kind, end_id, dtype, remember)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, n, tokens)], schema=_PART)

    parts = sorted(dealt.mapInArrow(sparing(write), "part long, docs long, tokens long").collect())
    manifest, doc_base, token_base = {"dtype": dtype, "end_id": end_id, "parts": []}, 0, 0
    for part, n, tokens in parts:
        manifest["parts"].append({"name": f"part-{part:05d}", "docs": n, "tokens": tokens, "doc_base": doc_base, "token_base": token_base})
        doc_base, token_base = doc_base + n, token_base + tokens
    with store.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/{MANIFEST}") as source:
        return json.loads(source.read())


def _mapped(store, path: str, dtype: str) -> np.ndarray:
    """The file's numbers: mapped into memory where the store is a disk, else read."""
    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if store.type_name == "local":
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype)


def read_part(folder: str, part: dict, dtype: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(key, ids of all documents before it, ids) of each document of one part."""
    store, root = _store(folder)
    index = _mapped(store, f"{root}/{part['name']}.idx", "<i8")
    n = int(index[0])
    offsets, keys, flags = index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 :]
    ids = _mapped(store, f"{root}/{part['name']}.bin", dtype)
    for i in range(n):
        yield int(keys[i]) if flags[i] else None, part["token_base"] + int(offsets[i]), ids[offsets[i] : offsets[i + 1]]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a dataset: doc_id, start (ids before it), n_tokens and its ids as little-endian unsigned 32 bit."""
    manifest = read_manifest(folder)
    dtype, parts = manifest["dtype"], [p for p in manifest["parts"] if p["docs"]]
    chosen = spark.createDataFrame([(json.dumps(p),) for p in parts], "part string").repartition(max(1, len(parts)))

    def read(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows, held = [], 0
                for key, start, ids in read_part(folder, json.loads(part), dtype):
                    rows.append((key, start, len(ids), ids.astype("<u4").tobytes()))
                    held += len(ids) * 4
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return chosen.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def crc32_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
