"""N-gram Jaccard join by parity sketches: which documents are near copies of each other, and the groups they form."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slabmill.llm.common import mixed, shingle_hashes, shuffle_partitions, slices, small_batches, sparing, word_hashes, words_of
from slabmill.llm.graph import components
from slabmill.llm.line_dedup import WHITE
from slabmill.llm.tokens import CUT_BYTES
from slabmill.session import stage

SHINGLE = 5
#: Sizes from FIRST_BAND * BAND**(j-1) up to FIRST_BAND * BAND**j are band j; its sketches have one block for SHINGLES_A_BLOCK of the largest size.
FIRST_BAND, BAND, SHINGLES_A_BLOCK = 16, 4, 2.2
_TOKENS = 255  # the band number of keys that are single shingles
#: A block that so many classes share counts as frequent; the most frequent ones are known to every task.
FREQUENT, MAX_FREQUENT = 8, 1_000_000
#: Keys that a task gathers before it passes them on.
_FLUSH = 1_000_000
#: Tasks that share the keys of one group, when classes are compared across groups.
_SPREAD = 8
_COMPARED = 2_000_000  # sketch words compared at once

_FIRST = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("sketch", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
_FIRST_SQL = "doc_id long, same long, n long, class long, sketch binary, keys binary, counts binary"
_KEYS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("classes", pa.binary())])
_LIVE = pa.schema([("key", pa.int64()), ("class", pa.int64())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SET = pa.schema([("class", pa.int64()), ("shingles", pa.binary())])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of one to four words is one shingle."""
    words = [words_of(t.lower()) for t in texts]
    ends = np.cumsum([0, *map(len, words)])
    hashes = word_hashes(chain.from_iterable(words), int(ends[-1]))
    shingles = shingle_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(shingles[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(shingle_hashes(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    """One number for equal sets, as a signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2^k buckets, 2^k being at least twice their number: each shingle in which two sets differ flips one
    bit, so the Hamming distance of two sketches is at most the size of the symmetric difference. Halves fold by XOR to a smaller k."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    where = (mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(where, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _bands(n: int) -> list[tuple[int, int]]:
    """(band, largest size) of a size, and of the next band where a partner may be in it."""
    j, high = 0, FIRST_BAND
    while n >= high:
        j, high = j + 1, high * BAND
    return [(j, high), (j + 1, high * BAND)] if 4 * n >= 3 * high else [(j, high)]


def block_keys(shingles: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each band of a set: the keys of its non-empty blocks, and how many of them a partner may lack.

    A block is a range of shingle hashes and its key the XOR of all mixed hashes in it (a wide parity), with the block's place. Sets of
    a similarity of 0.75 or more differ in at most a third of their size, and each difference spoils one block. Where a set has too few
    non-empty blocks for this bound, its single shingles are keys too, of which a partner lacks at most a quarter.
    """
    n, out, short = len(shingles), [], False
    for band, high in _bands(n):
        blocks = max(1, int(high / SHINGLES_A_BLOCK))
        block = (shingles >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        parity = np.bitwise_xor.reduceat(mixed(shingles), first)
        keys = mixed(parity ^ mixed(block[first] + np.uint64(band << 40)))
        short |= len(keys) <= n // 3
        out.append((keys, n // 3))
    if short:
        out.append((mixed(shingles ^ mixed(np.uint64([_TOKENS << 40]))), n // 4))
    return out


def _selected(shingles: np.ndarray, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Keys by which a set is found: in an order that all sets share, rare ones first, one more than a partner may lack.

    The first key that two linked sets have in common is then among those of both.
    """
    out = []
    for keys, lacking in block_keys(shingles):
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
            own = np.where(frequent[at] == keys, level[at], 0)
        else:
            own = np.zeros(len(keys), np.int64)
        out.append(keys[np.lexsort((keys, own))[: lacking + 1]])
    return np.concatenate(out)


def _documents(rows: DataFrame) -> DataFrame:
    """A row for each document with its class and sketch, and rows of the keys that classes of one task share, with counts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def shared() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keys, counts = keys[counts > 1], counts[counts > 1]
            columns = [*[[None]] * 5, [keys.tobytes()], [counts.astype("<i8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIRST, strict=True)], schema=_FIRST)

        for batch, texts in slices(batches, size=CUT_BYTES):
            out = []
            for key, same, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(texts), strict=True):
                if not len(s):
                    out.append((key, same, 0, None, None, None, None))
                    continue
                own = class_of(s)
                out.append((key, same, len(s), own, parity_sketch(s), None, None))
                if own not in met:
                    met.add(own)
                    for keys, _ in block_keys(s):
                        held.append(keys)
                        size += len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FIRST, strict=True)], schema=_FIRST)
            if size >= _FLUSH:
                yield from shared()
                met, held, size = set(), [], 0
        if held:
            yield from shared()

    return rows.mapInArrow(sparing(measure), _FIRST_SQL)


def _frequent(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys and their levels (logarithms of their counts). They order keys; what is not among them is only found later."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8")), pa.array(np.frombuffer(counts, "<i8"))], schema=_LIVE)

    keys = measured.where("keys is not null").select("keys", "counts").mapInArrow(sparing(unpack), "key long, class long")
    top = keys.groupBy("key").agg(F.sum("class").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).toArrow()
    key, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], np.log2(np.maximum(n[order], 1)).astype(np.int64)


def _live_keys(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, class) for every key that several classes have. Keys travel packed, by ranges of their hash; a task passes on a class once."""
    spark = rows.sparkSession
    parts = shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(frequent)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = shared.value
        met: set[int] = set()
        keys: list[np.ndarray] = []
        classes: list[np.ndarray] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            key, own = np.concatenate(keys), np.concatenate(classes)
            keys.clear()
            classes.clear()
            order = np.argsort(key)
            key, own = key[order], own[order]
            part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(part, np.arange(parts + 1))
            some = [p for p in range(parts) if ends[p] < ends[p + 1]]
            columns = [some, *([x[ends[p] : ends[p + 1]].tobytes() for p in some] for x in (key, own))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEYS, strict=True)], schema=_KEYS)

        for _, texts in slices(batches, size=CUT_BYTES):
            for s in shingle_sets(texts):
                if len(s) and (own := class_of(s)) not in met:
                    met.add(own)
                    keys.append(_selected(s, known, level))
                    classes.append(np.full(len(keys[-1]), own, np.int64))
                    size += len(keys[-1])
            if size >= _FLUSH:
                yield from packed()
                met, keys, classes, size = set(), [], [], 0
        if keys:
            yield from packed()

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            keys += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            classes += [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        key, own = np.concatenate(keys), np.concatenate(classes)
        del keys, classes
        if not len(key):
            return
        order = np.argsort(key)
        key, own = key[order], own[order]
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        several = same[1:] | same[:-1]
        pairs = np.unique(np.stack([key[several].view(np.int64), own[several]], axis=1), axis=0)
        first = np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]]) if len(pairs) else np.zeros(0, bool)
        many = np.repeat(*(lambda n: (n > 1, n))(np.diff(np.append(np.flatnonzero(first), len(pairs)))))
        for at in range(0, int(many.sum()), 1 << 18):
            part = pairs[many][at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], schema=_LIVE)

    packs = rows.select("doc_id", "text").mapInArrow(sparing(pack), "part int, keys binary, classes binary")
    return packs.repartitionById(parts, F.col("part")).mapInArrow(sparing(live), "key long, class long")


def _stars(live: DataFrame) -> DataFrame:
    """Pairs of each class with one leader a key: the class that has most keys in common with others."""
    weight = live.groupBy("class").agg(F.count("*").alias("weight"))
    leaders = live.join(weight, "class").groupBy("key").agg(F.max(F.struct("weight", "class"))["class"].alias("leader"))
    pairs = live.join(leaders, "key").where(F.col("class") != F.col("leader"))
    return pairs.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct()


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_link(n: np.ndarray, sketches: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs in different groups whose sizes and sketches allow a similarity of 0.75, compared block by block."""
    words = np.array([len(s) // 8 for s in sketches])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    by_width = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
    rows = {w: np.stack([np.frombuffer(sketches[i], np.uint64) for i in at]) for w, at in by_width.items()}
    for w, mine in by_width.items():
        for v in (w, 2 * w):
            if v not in by_width:
                continue
            theirs, folded = by_width[v], _folded(rows[v], w)
            step = max(1, _COMPARED // (len(theirs) * w))
            for at in range(0, len(mine), step):
                i = mine[at : at + step, None]
                j = theirs[None, :]
                fits = (group[i] != group[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
                if v == w:
                    fits &= i < j
                x, y = np.nonzero(fits)
                for k in range(0, len(x), max(1, _COMPARED // w)):
                    p, q = x[k : k + max(1, _COMPARED // w)], y[k : k + max(1, _COMPARED // w)]
                    distance = np.bitwise_count(rows[w][at + p] ^ folded[q]).sum(axis=1, dtype=np.int64)
                    good = 7 * distance <= n[mine[at + p]] + n[theirs[q]]
                    left.append(mine[at + p[good]])
                    right.append(theirs[q[good]])
    return np.concatenate(left), np.concatenate(right)


def _sketch_allows(sizes_a: pa.Array, a: pa.Array, sizes_b: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for n, x, m, y in zip(sizes_a.to_pylist(), a.to_pylist(), sizes_b.to_pylist(), b.to_pylist(), strict=True):
        p, q = (np.frombuffer(s, np.uint64)[None, :] for s in (x, y))
        width = min(p.shape[1], q.shape[1])
        out.append(7 * int(np.bitwise_count(_folded(p, width) ^ _folded(q, width)).sum()) <= n + m)
    return pa.array(out)


def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(p, q, assume_unique=True))
        out.append(100 * common >= 75 * (len(p) + len(q) - common))
    return pa.array(out)


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that are linked: sizes, then sketches, then the whole shingle sets of the texts that are left."""
    own = lambda side: classes.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    allows = F.arrow_udf(_sketch_allows, "boolean")
    sized = pairs.join(own("a"), "a").join(own("b"), "b").where(4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))
    likely = stage(sized.where(allows("n_a", "sketch_a", "n_b", "sketch_b")).select("a", "b"), "likely-pairs")
    needed = likely.select(F.col("a").alias("class")).union(likely.select("b")).distinct()
    texts = needed.join(classes, "class").select("class", "first_doc")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in slices(batches, size=CUT_BYTES):
            made = shingle_sets(found)
            columns = [[class_of(s) for s in made], [s.tobytes() for s in made]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SET, strict=True)], schema=_SET)

    firsts = texts.select("first_doc").distinct()
    wanted = rows.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_doc")), "left_semi")
    made = wanted.select("doc_id", "text").mapInArrow(sparing(sets), "class long, shingles binary").dropDuplicates(["class"])
    side = lambda s: made.select(F.col("class").alias(s), F.col("shingles").alias(f"set_{s}"))
    met = likely.join(side("a"), "a").join(side("b"), "b")
    return met.where(F.arrow_udf(_linked, "boolean")("set_a", "set_b")).select("a", "b")


def _open(live: DataFrame, groups: DataFrame) -> DataFrame:
    """``key``, ``class`` and ``group`` of the keys whose classes are not in one group yet, and ``low``, the smallest group there."""
    grouped = live.join(groups, live["class"] == groups["node"], "left").select("key", "class", F.coalesce("component", "class").alias("group"))
    open_keys = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select("key", "low")
    return grouped.join(open_keys, "key")


def _second_stars(rows: DataFrame) -> DataFrame:
    """Pairs of one more leader a key with the classes outside its group: of those outside the key's largest group, the class with most open keys."""
    largest = rows.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "group"))["group"].alias("largest"))
    weight = rows.groupBy("class").agg(F.count("*").alias("weight"))
    outside = rows.join(largest, "key").where("group != largest").join(weight, "class")
    leaders = outside.groupBy("key").agg(F.max(F.struct("weight", "class", "group")).alias("l")).select("key", F.col("l.class").alias("leader"), F.col("l.group").alias("led"))
    pairs = rows.join(leaders, "key").where("group != led")
    return pairs.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct()


def _across(live: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes with a key in common that are not in one group yet and whose sketches allow a link."""
    spark = live.sparkSession
    members = _open(live, groups).join(classes.select("class", "n", "sketch"), "class")
    # Keys of one group of near copies hold the same pairs again and again: in a few tasks, which pass on a pair once.
    place = [F.col("low"), F.pmod(F.xxhash64("key"), F.lit(_SPREAD))]
    dealt = members.repartition(shuffle_partitions(spark), *place).sortWithinPartitions("key").select("key", "class", "group", "n", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found = None, set()
        for batch in chain(batches, [None]):
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if rest is not None or batch is not None else None
            if table is None or not len(table):
                continue
            key, own, group, n = (table.column(i).to_numpy() for i in range(4))
            sketch = table.column(4).to_pylist()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            ends = [*first[1:], len(key)]
            if batch is not None:  # the last key may go on
                rest = table.slice(first[-1]).combine_chunks().to_batches()[0]
                first, ends = first[:-1], ends[:-1]
            for a, b in zip(first, ends, strict=True):
                x, y = may_link(n[a:b], sketch[a:b], group[a:b])
                found.update(zip(np.minimum(own[a:b][x], own[a:b][y]).tolist(), np.maximum(own[a:b][x], own[a:b][y]).tolist(), strict=True))
            if len(found) > 100_000 or batch is None:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], schema=_PAIR)
                found = set()

    return dealt.mapInArrow(sparing(compare), "a long, b long").distinct()


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row; no other column is read.

    A document's set holds the distinct runs of five words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) of its whole text; with fewer words, the
    whole text as one. Two documents link where 100 * intersection >= 75 * union, and ``component_id`` is the smallest key that links
    reach, the own one included. A text without words, or NULL, links with nothing, not even its like. Repeated rows link with each other; a NULL key is
    larger than any other (and stays NULL where a component has no other). Sets are compared by 64-bit hashes of their shingles.

    Equal sets are one class from the start. Parity sketches per size band are cut into blocks; of linked sets, few blocks differ, so
    each class is filed under some of its blocks, rare ones first, and linked classes meet in one (see :func:`block_keys`). In each such key
    every class is first compared with one leader; links make groups, and in keys with several groups a leader from outside the largest is compared with the rest. Then the classes of a key that are still in different groups are
    compared pair by pair inside the task by their sketches, without a row for a pair unless its sketches allow a link; sizes, sketches
    and at last the whole sets decide. So every link between different groups is found, and pairs inside a group are not listed.
    """
    found = _grouped(docs, key, text)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one of each group of :func:`near_copy_groups` is kept: the one with the smallest key
    (NULL last), of rows with one key that with the smaller text hash, of equal rows any. Texts without words all stay."""
    groups = stage(_grouped(docs, key, text), "groups").where("n > 0")
    name = lambda c: F.coalesce(c.cast("long"), F.lit((1 << 63) - 1))
    chosen = groups.groupBy("group").agg(F.min(F.struct(name(F.col("doc_id")).alias("id"), "same")).alias("k")).select("k.id", "k.same", F.lit(True).alias("chosen"))
    gone = groups.select(name(F.col("doc_id")).alias("id"), "same").distinct().join(chosen, ["id", "same"], "left").where("chosen is null").select("id", "same")
    rows = docs.select(F.struct("*").alias("row"), name(F.col(key)).alias("id"), F.xxhash64(F.col(text)).alias("same"))
    left = rows.join(gone, ["id", "same"], "left_anti")
    copy = F.row_number().over(Window.partitionBy("id", "same").orderBy("same"))
    wordless = F.coalesce(F.btrim(F.col("row")[text], F.lit(WHITE)), F.lit("")) == ""
    return left.withColumn("copy", copy).where((F.col("copy") == 1) | wordless).select("row.*")


def _grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, same (text hash), n, class, group (a number for each component) and component_id of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("same"))
    measured = stage(_documents(rows), "classes")
    documents = measured.where("keys is null").select("doc_id", "same", "n", "class", "sketch")
    classes = stage(documents.where("n > 0").groupBy("class").agg(F.min("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first_doc")), "class-sketches")
    live = stage(_live_keys(rows, _frequent(measured)), "live-keys")
    stars = stage(_verified(_stars(live), classes, rows), "links")
    groups = components(stars)
    left = stage(_open(live, groups), "open-keys")
    stars = stars.union(stage(_verified(_second_stars(left), classes, rows), "links"))
    groups = components(stars)
    more = stage(_verified(_across(left.select("key", "class"), groups, classes), classes, rows), "links")
    groups = components(stars.union(more))

    known = classes.select("class", "first_doc").join(groups, classes["class"] == groups["node"], "left").select("class", "first_doc", F.coalesce("component", "class").alias("group"))
    smallest = known.groupBy("group").agg(F.min("first_doc").alias("component_id"))
    of_class = known.join(smallest, "group").select("class", "group", "component_id")
    return documents.drop("sketch").join(of_class, "class", "left")
