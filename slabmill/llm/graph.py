"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabmill.llm.common import sparing
from slabmill.session import cut_lineage

#: Edges that one task contracts at once.
EDGES_PER_TASK = 1_000_000
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (columns ``a`` and ``b``, longs; best a stored table).

    Edges are dealt to tasks of about ``EDGES_PER_TASK``, each of which contracts its own to stars around the smallest nodes it sees. One task's stars
    are the components; those of several are contracted further by large-star and small-star steps (Kiveris et al., 2014) until nothing
    changes. A step joins each edge with its node's smallest neighbour, which is a partial aggregate, so no neighbourhood is gathered.
    Each round is checkpointed.
    """
    pairs = edges.select("a", "b")
    tasks = -(-pairs.count() // EDGES_PER_TASK) or 1
    now = cut_lineage(pairs.repartition(tasks).mapInArrow(sparing(_contracted), "a long, b long"))
    while tasks > 1:
        after = cut_lineage(_small_star(_large_star(now)))
        if now.exceptAll(after).isEmpty() and after.exceptAll(now).isEmpty():
            break
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (node, smallest node) of the components of a task's edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    stars = [(x, root(x)) for x in parent]
    stars = [s for s in stars if s[0] != s[1]]
    for at in range(0, len(stars), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars[at : at + 100_000], strict=True)], schema=_EDGE)


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours larger than a node are joined to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the smallest of them."""
    down = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least, "a")
    return met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m"))).distinct()
