"""Benchmark decontamination: SimHash fingerprints of item-sized windows, then exact similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabmill.llm.common import give_back, mixed, shingle_hashes, small_batches, word_hashes, words_of

SHINGLE = 5
SIMILARITY = 0.75
#: Fingerprint bits and the radius that is searched. Multisets at a similarity of 0.75 differ in 22 of 128 bits on average, with a
#: deviation of 4.3, so a radius of 40 is over four deviations away.
BITS = 128
RADIUS = 40
BLOCK_BITS = 8
#: Items and text bytes of one index; a larger benchmark makes several, each met with all documents.
ITEMS_PER_INDEX = 10_000
BYTES_PER_INDEX = 16 << 20
#: Text bytes that are hashed at once.
_AT_ONCE = 4 << 20

HITS = "array<struct<item_id: bigint, similarity: double, start_word: bigint, n_words: bigint>>"
_HIT = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a multiset of 64-bit shingle hashes as 16 bytes: in each bit, what most shingles (repeats count) have there."""
    wide = np.stack([shingles, mixed(shingles + np.uint64(1))], axis=1)
    bits = np.unpackbits(wide.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles))


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger multiplicities."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common)


def _near_values() -> list[np.ndarray]:
    """For each block value, the values within the block radius: of all blocks of two fingerprints within ``RADIUS``, one is as near."""
    radius = RADIUS // (BITS // BLOCK_BITS)
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BLOCK_BITS), k)]
    return [np.array([v ^ m for m in masks]) for v in range(1 << BLOCK_BITS)]


class BenchmarkIndex:
    """Fingerprints and shingles of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        words = [words_of(t.encode().lower()) for _, t in items]
        self.n_words = np.array([len(w) for w in words])
        self.shingles = [shingle_hashes(word_hashes(w, len(w)), SHINGLE) for w in words]
        self.prints = np.stack([fingerprint(s) for s in self.shingles])
        owners = np.repeat(np.arange(len(items)), [len(s) for s in self.shingles])
        pairs = np.unique(np.stack([np.concatenate(self.shingles), owners.astype(np.uint64)], axis=1), axis=0)
        self.known, first, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        self.first, self.count, self.owner = first, count, pairs[:, 1].astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)  # leading bits of the known shingles, as a quick no
        self.seen[self.known >> np.uint64(44)] = True
        near = _near_values()
        holders: list[list[list[int]]] = [[[] for _ in near] for _ in range(BITS // BLOCK_BITS)]
        for i, own in enumerate(self.prints):
            for block, value in enumerate(own):
                for v in near[value]:
                    holders[block][v].append(i)
        self.holders = [[np.array(x, np.int64) for x in block] for block in holders]

    def within_radius(self, own: np.ndarray) -> np.ndarray:
        """Every item whose fingerprint is within the radius."""
        found = np.unique(np.concatenate([self.holders[block][value] for block, value in enumerate(own)]))
        return found[np.bitwise_count(self.prints[found] ^ own).sum(axis=1) <= RADIUS]

    def search(self, texts: list[bytes]) -> list[list[dict] | None]:
        """For each text its items with the best window of each; None where there are none."""
        words = [words_of(t.lower()) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        total = int(ends[-1]) if len(ends) else 0
        shingles = shingle_hashes(word_hashes(chain.from_iterable(words), total), SHINGLE)
        # A window without a shingle of an item has similarity 0 to it, and the best window of an item begins with one of its shingles.
        at = np.flatnonzero(self.seen[shingles >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        true = self.known[place] == shingles[at]
        at, place = at[true], place[true]
        text = np.searchsorted(ends, at, "right")
        inside = at + SHINGLE <= ends[text]
        at, place, text = at[inside], place[inside], text[inside]
        out: list[list[dict] | None] = [None] * len(texts)
        if not len(at):
            return out
        n = self.count[place]
        spread = np.repeat(np.arange(len(at)), n)
        item = self.owner[np.repeat(self.first[place], n) + np.arange(len(spread)) - np.repeat(np.cumsum(n) - n, n)]
        at, text = at[spread], text[spread]
        order = np.lexsort((at, item, text))
        at, item, text = at[order], item[order], text[order]
        length = self.n_words[item]
        begin = np.maximum(np.minimum(at, ends[text] - length), np.where(text > 0, ends[text - 1], 0))
        stop = np.minimum(begin + length, ends[text]) - SHINGLE + 1  # of its shingles
        # Hits of one text and item are neighbours, so those in a window are counted between two places.
        step = np.int64(total + 1)
        group = np.cumsum(np.r_[0, (np.diff(text) != 0) | (np.diff(item) != 0)]).astype(np.int64) * step
        common = np.searchsorted(group + at, group + stop) - np.searchsorted(group + at, group + begin)
        own, theirs = stop - begin, length - SHINGLE + 1
        common = np.minimum(np.minimum(common, own), theirs)
        likely = np.flatnonzero(common >= SIMILARITY * (own + theirs - common))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        last = None
        for k in likely:
            window = (int(text[k]), int(begin[k]), int(stop[k]))
            if window == last:
                continue
            last = window
            mine = shingles[window[1] : window[2]]
            of_text = int(ends[window[0]]) - (int(ends[window[0] - 1]) if window[0] else 0)
            for i in self.within_radius(fingerprint(mine)):
                if min(int(self.n_words[i]), of_text) != len(mine) + SHINGLE - 1:
                    continue  # an item's windows have its own number of words
                similarity = weighted_jaccard(mine, self.shingles[i])
                if similarity >= SIMILARITY and similarity > best.get((window[0], int(i)), (0.0,))[0]:
                    best[window[0], int(i)] = (similarity, window[1], len(mine) + SHINGLE - 1)
        for (t, i), (similarity, start, n_words) in sorted(best.items()):
            hit = {"item_id": self.ids[i], "similarity": similarity, "start_word": start - (int(ends[t - 1]) if t else 0), "n_words": n_words}
            out[t] = [*(out[t] or []), hit]
        return out


def _indexes(benchmark: DataFrame, item: str, text: str) -> Iterator[BenchmarkIndex]:
    held, size = [], 0
    for key, body in benchmark.select(F.col(item).cast("long"), F.col(text)).orderBy(item, text).toLocalIterator():
        if body is not None and len(words_of(body.encode())) >= SHINGLE:
            held.append((key, body))
            size += len(body)
            if len(held) >= ITEMS_PER_INDEX or size >= BYTES_PER_INDEX:
                yield BenchmarkIndex(held)
                held, size = [], 0
    if held:
        yield BenchmarkIndex(held)


def _searcher(shared: Broadcast[BenchmarkIndex]):
    @F.arrow_udf(HITS)
    def search(texts: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        for t in texts.cast(pa.large_binary()).to_pylist():
            held.append(t or b"")
            size += len(held[-1])
            if size > _AT_ONCE:
                out += shared.value.search(held)
                held, size = [], 0
        out += shared.value.search(held)
        give_back()
        return pa.array(out, pa.list_(_HIT))

    return search


def with_benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", hits: str = "hits") -> DataFrame:
    """All columns of ``docs`` plus ``hits``: the benchmark items that a passage of the text repeats, NULL where there are none.

    A text repeats an item where a window of as many words as the item (or the whole text, if shorter) has a similarity of at least 0.75 to it: weighted Jaccard of five-word
    shingles, repeats counted, words being runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. The SimHash of each window that can
    reach this is looked up in a multi-index of blocks, which yields every item within the radius, and the similarity of those
    is computed exactly. A hit has the item, the similarity, and the first word and the number of words of the item's best window.

    Documents are read once for each index of at most ``ITEMS_PER_INDEX`` items, without any shuffle; an index is broadcast, its size
    bounded. Items of fewer than five words have no shingle and NULL texts no words: neither ever matches. Repeated items each count.
    A column that has the name of ``hits`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = F.lit(None).cast(HITS)
    for index in _indexes(benchmark, item, item_text):
        search = _searcher(spark.sparkContext.broadcast(index))
        here = search(F.col(text))
        found = F.when(found.isNull(), here).otherwise(F.concat(found, F.coalesce(here, F.array().cast(HITS))))
    return docs.withColumn(hits, found)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it repeats: ``key``, item_id, similarity, start_word, n_words."""
    met = with_benchmark_hits(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark)
    return met.where("hits is not null").select("key", F.explode("hits").alias("hit")).select(F.col("key").alias(key), "hit.*")
