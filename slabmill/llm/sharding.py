"""Sharding by histogram sort: near-equal bytes a shard, texts exchanged once."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabmill.llm.common import shuffle_partitions, small_batches
from slabmill.session import stage

#: Candidate boundaries that one round counts for each boundary that is still open.
PROBES = 16
_HALF, _SPAN = 1 << 63, 1 << 64
_COUNTS = pa.schema([("bucket", pa.int64()), ("bytes", pa.int64()), ("rows", pa.int64())])


def _as_array(points: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(p.to_bytes(16, "big") for p in points), "S16")


def _keys(group: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Sort keys (text hash, id) of two signed 64-bit columns as 16 comparable bytes."""
    pair = np.empty((len(group), 2), ">u8")
    pair[:, 0] = group.view(np.uint64) ^ np.uint64(_HALF)
    pair[:, 1] = member.view(np.uint64) ^ np.uint64(_HALF)
    return pair.reshape(-1).view("S16")


def _count_between(rows: DataFrame, points: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below the first of the sorted points, between neighbours, and from the last on."""
    edges = _as_array(points)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            group, member, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = np.searchsorted(edges, _keys(group, member), "right")
            np.add.at(size, at, own)
            n += np.bincount(at, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (some, size[some], n[some])], schema=_COUNTS)

    size, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    counted = rows.select("group", "member", "size").mapInArrow(count, "bucket long, bytes long, rows long")
    for b, s, r in counted.groupBy("bucket").agg(F.sum("bytes"), F.sum("rows")).collect():  # at most one row a point
        size[b], n[b] = s, r
    return size, n


def find_splitters(rows: DataFrame, wanted: int, tolerances: list[float]) -> list[int]:
    """``wanted - 1`` boundaries between parts of near-equal bytes.

    Each round counts the bytes below some candidates for each open boundary and narrows its interval. A boundary is settled when its
    error is within its tolerance (a share of the mean part). Candidates lie between groups of equal texts first, and inside
    a group only where the group itself is too large for the tolerance.
    """
    total, low, high = rows.agg(F.sum("size"), F.min("member"), F.max("member")).first()
    if total is None or wanted < 2:
        return [0] * (wanted - 1)
    first, beyond = low + _HALF, high + _HALF + 1  # ids in a group, as unsigned numbers
    targets = [total * i / wanted for i in range(1, wanted)]
    below = {0: 0, _SPAN * _SPAN: total}
    settled: dict[int, int] = {}
    while len(settled) < len(targets):
        ends = sorted(below)
        heights = [below[e] for e in ends]
        fresh: set[int] = set()
        for i, target in enumerate(targets):
            if i in settled:
                continue
            right = max(1, bisect_left(heights, target))
            lo, hi = ends[right - 1], ends[right]
            near = lo if target - below[lo] <= below[hi] - target else hi
            groups = hi // _SPAN - lo // _SPAN
            if lo % _SPAN or hi % _SPAN or groups == 1:  # between ids of one group of equal texts
                base = lo // _SPAN * _SPAN
                lo, hi = max(lo, base + first), min(hi, base + beyond) if hi < base + _SPAN else base + beyond
                steps = sorted({lo + (hi - lo) * k // (PROBES + 1) for k in range(1, PROBES + 1)} | {lo, hi})
            else:
                steps = sorted({(lo // _SPAN + groups * k // (PROBES + 1)) * _SPAN for k in range(1, PROBES + 1)})
            steps = [s for s in steps if s not in below and s < _SPAN * _SPAN]
            if abs(below[near] - target) <= tolerances[i] * total / wanted or not steps:
                settled[i] = near
            fresh.update(steps if i not in settled else ())
        if fresh:
            points = sorted(fresh)
            counts, _ = _count_between(rows, points)
            below |= dict(zip(points, np.cumsum(counts)[:-1].tolist(), strict=True))
    return [min(settled[i], _SPAN * _SPAN - 1) for i in range(len(targets))]


def shard_documents(
    docs: DataFrame, shards: int = 24, overhead: int = 8, tolerance: float = 0.002, inner_tolerance: float = 0.2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All columns of ``docs`` plus ``size``, ``shard`` and ``slot``, dealt to near-equal bytes a shard.

    ``size`` is the text's UTF-8 bytes plus ``overhead``. Rows are ordered by (text hash, key): equal texts are neighbours and
    stay in one shard unless a boundary can meet the tolerance (a share of the mean shard) only inside their group, so a group that
    holds a third of all rows is cut and not gathered. Rows alike in text and key can't be told apart and stay together.
    Each shard is exchanged and sorted in several buckets of near-equal bytes (the same search with a wider tolerance), and a
    bucket's first slot is the prefix sum of the rows before it, so a shard of any size is never in one task. ``slot`` counts
    from 0 in each shard without gaps. A NULL text has ``overhead`` bytes; NULL keys come first. Columns of the input that have one of the three
    names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = max(1, -(-shuffle_partitions(spark) // shards))
    buckets = shards * pieces
    own = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    group, member = F.xxhash64(F.col(text)), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(overhead)
    narrow = stage(docs.select(group.alias("group"), member.alias("member"), size.alias("size")), "shard-keys")
    splitters = find_splitters(narrow, buckets, [tolerance / pieces if i % pieces == 0 else inner_tolerance for i in range(1, buckets)])
    splitters = np.maximum.accumulate(np.array(splitters, object)).tolist() if splitters else []
    _, rows = _count_between(narrow, splitters)
    first = np.concatenate([[0], np.cumsum(rows)])[:-1]
    base = [int(first[b] - first[b // pieces * pieces]) for b in range(buckets)]
    edges = _as_array(splitters)

    @F.pandas_udf("int")
    def bucket(groups: pd.Series, members: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _keys(groups.to_numpy(), members.to_numpy()), "right").astype(np.int32))

    row = docs.select(F.struct(*own).alias("row"), group.alias("group"), member.alias("member"), size.alias("size"))
    dealt = row.withColumn("bucket", bucket("group", "member")).repartitionById(buckets, F.col("bucket"))
    before = F.row_number().over(_in_bucket()) - 1
    start = F.element_at(F.array(*map(F.lit, base)), F.col("bucket") + 1).cast("long")
    placed = dealt.withColumn("slot", start + before).withColumn("shard", (F.col("bucket") / pieces).cast("int"))
    return placed.select("row.*", "size", "shard", "slot")


def _in_bucket():
    from pyspark.sql import Window

    return Window.partitionBy("bucket").orderBy("group", "member")
