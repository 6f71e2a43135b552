"""Best-fit packing by sums of squares: documents into sequences of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabmill.llm.common import SLICE_BYTES, slices, small_batches, sparing
from slabmill.llm.tokens import REMEMBERED_BYTES, WHITESPACE, encoder
from slabmill.session import stage

CAPACITY = 4096
#: Sequences filled to less than this share are opened again and packed together with those of other tasks.
WELL_FILLED = 0.98
#: Pieces that one task of the second round packs.
PIECES_PER_TASK = 100_000
#: Sequence ids of a task start at its number times this; those of the second round are negative.
TASK_SPAN = 1 << 33

PIECES = "doc_id long, piece int, start long, length long, ids binary"
PLACED = PIECES + ", sequence_id long, offset long"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("filled", pa.int64())]
)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed longest first.

    Of the open bins with room, a length goes where the sum over gaps of the squared number of open bins with that gap
    becomes smallest (of equal choices, the smallest gap); a new bin is opened where no open bin has room. The state
    is a count for each gap, whatever the number of lengths.
    """
    order = np.argsort(-lengths, kind="stable")
    count, at = np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    worst = np.int64(1 << 60)
    for i in order:
        size = int(lengths[i])
        here = count[size:capacity]
        if size < capacity and here.any():
            change = 2 * (count[: capacity - size] - here) + 2
            change[0] = 1 - 2 * here[0]  # a full bin is open no longer
            gap = size + int(np.where(here > 0, change, worst).argmin())
            bins[i] = at[gap].pop()
            offsets[i] = capacity - gap
            count[gap] -= 1
        else:
            gap, bins[i] = capacity, opened
            opened += 1
        if gap > size:
            count[gap - size] += 1
            at[gap - size].append(int(bins[i]))
    return bins, offsets


def _pieces(doc_ids: list, encoded: list[bytes], end: bytes, capacity: int) -> Iterator[tuple]:
    for key, ids in zip(doc_ids, encoded, strict=True):
        ids += end
        for piece, cut in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[cut : cut + 4 * capacity]
            yield key, piece, cut // 4, len(part) // 4, part


def _placed(rows: list[tuple], capacity: int, base: int) -> Iterator[pa.RecordBatch]:
    # The order of the rows must not hang on the order in which a task got them.
    rows.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[4]))
    lengths = np.fromiter((r[3] for r in rows), np.int64, len(rows))
    bins, offsets = sum_of_squares(lengths, capacity)
    filled = np.bincount(bins, lengths, minlength=int(bins.max()) + 1).astype(np.int64) if len(rows) else bins
    for at in range(0, len(rows), 2000):
        part = rows[at : at + 2000]
        chosen = bins[at : at + 2000]
        columns = [*zip(*part, strict=True), base + chosen, offsets[at : at + 2000], filled[chosen]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", kind: str = WHITESPACE,
    remember: int = REMEMBERED_BYTES, cut: int = SLICE_BYTES,
) -> DataFrame:
    """Encode documents, cut those over ``capacity`` and place all pieces in sequences; one row a piece with its ids.

    Each task encodes and packs the rows of its own split, so no text is shuffled. What a task leaves in sequences that
    are not ``WELL_FILLED`` is packed again over all tasks, in groups of about ``PIECES_PER_TASK`` pieces, so the loss is
    a few sequences in all and not a few a split. Sequence ids are unique numbers without further meaning.
    NULL texts are empty (one end id); NULL or repeated keys are packed like others; other columns are not read.
    ``remember`` bounds the encoder's memory of chunks and ``cut`` the text bytes it takes at once, for executors that earlier steps have filled;
    they change no result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def first(batches):
        encode, pieces = encoder(tokenizer_path, kind, remember=remember).encode, []
        for batch, texts in slices(batches, size=cut):
            pieces += _pieces(batch.column(0).to_pylist(), encode(texts), end, capacity)
        yield from _placed(pieces, capacity, TaskContext.get().partitionId() * TASK_SPAN)

    packed = stage(rows.mapInArrow(sparing(first), PLACED + ", filled long"), "packed")
    loose = F.col("filled") < int(WELL_FILLED * capacity)
    groups = packed.where(loose).agg(F.ceil(F.count("*") / PIECES_PER_TASK)).first()[0] or 1
    again = packed.where(loose).withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(groups)).cast("int"))

    def second(batches):
        pieces: dict[int, list] = {}
        for batch in batches:
            for *row, group in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                pieces.setdefault(group, []).append(tuple(row))
        for group, held in sorted(pieces.items()):
            yield from _placed(held, capacity, -(group + 1) * TASK_SPAN)

    repacked = again.select("doc_id", "piece", "start", "length", "ids", "group").repartition(groups, "group").mapInArrow(sparing(second), PLACED + ", filled long")
    return packed.where(~loose).unionByName(repacked).drop("filled")
