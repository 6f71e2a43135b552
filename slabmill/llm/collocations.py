"""Collocations: phrases that occur oftener than their parts explain, counted exactly in HAT-tries that spill sorted runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slabmill.llm.common import mixed, slices, small_batches
from slabmill.session import stage

#: A-Z lower-cased, tabs to spaces, piece ends to line feeds.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_NOTHING, _END = 0, 1
#: Phrases that a task's trie holds before it spills, and those of one container before it bursts.
HELD_PHRASES, BURST = 1_000_000, 1 << 15
#: Words that a task numbers before it spills all it has and begins anew.
HELD_WORDS = 600_000
#: Bits of the filter of frequent word pairs: 16 a pair, within these powers of two (1 KB and 32 MB).
LEAST_FILTER, MOST_FILTER = 13, 28
_SLICE_BITS = 20
#: Parts that a language's candidates are ranked in before their first ones meet.
RANKED_PARTS = 64

_SHORT = pa.schema([("m", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("lang", pa.string()), ("word", pa.string())])
_LONG = pa.schema([("m", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("h3", pa.int64()), ("h4", pa.int64()), ("n", pa.int64())])
_TYPES = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
_KEY = ["h1", "h2", "h3", "h4"]


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_TYPES[f.type]}" for f in schema)


class Numbers(dict):
    """Numbers things in the order in which they are first met."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class HatTrie:
    """Counts of paths of two numbers (a word or pair of words, then what follows it), in hash containers that burst.

    A container holds all paths within a range of first numbers. One that grows beyond ``burst`` paths is split at a first number, and one that has a
    single first number by the second, so inner nodes are just the sorted borders and frequent words get containers of their own.
    """

    def __init__(self, held: int = HELD_PHRASES, burst: int = BURST):
        self._held, self._burst = held, burst
        self._clear()

    def _clear(self) -> None:
        self._borders, self._containers, self._met, self.size = [np.iinfo(np.int64).min], [Counter()], [0], 0

    def add(self, paths: np.ndarray) -> None:
        """Count each of these (first << 32 | second), sorted."""
        cuts = np.searchsorted(paths, np.array(self._borders[1:], np.int64)).tolist()
        for i in reversed(range(len(self._containers))):
            a, b = cuts[i - 1] if i else 0, cuts[i] if i < len(cuts) else len(paths)
            if a == b:
                continue
            container = self._containers[i]
            before = len(container)
            container.update(paths[a:b].tolist())
            self._met[i] += b - a
            self.size += len(container) - before
            if len(container) > self._burst:
                self._split(i)

    def _split(self, i: int) -> None:
        container = self._containers[i]
        paths = np.sort(np.fromiter(container, np.int64, len(container)))
        firsts = paths >> 32
        middle = int(np.searchsorted(firsts, firsts[len(firsts) // 2]))
        if not middle:
            middle = int(np.searchsorted(firsts, firsts[0], "right"))
        if middle == len(paths):
            middle //= 2
        border = int(paths[middle])
        upper = Counter({k: n for k, n in container.items() if k >= border})
        for k in upper:
            del container[k]
        share = sum(upper.values())
        self._borders.insert(i + 1, border)
        self._containers.insert(i + 1, upper)
        self._met.insert(i + 1, share)
        self._met[i] -= share

    def spill(self, everything: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs (paths, counts) of whole subtrees, those with the fewest repeats first, until the trie is half empty."""
        order = sorted(range(len(self._containers)), key=lambda i: self._met[i] / max(1, len(self._containers[i])))
        for i in order:
            if not everything and self.size <= self._held // 2:
                return
            container = self._containers[i]
            if container:
                n = len(container)
                yield np.fromiter(container.keys(), np.int64, n), np.fromiter(container.values(), np.int64, n)
                self.size -= n
                self._containers[i], self._met[i] = Counter(), 0
        self._clear()

    @property
    def full(self) -> bool:
        return self.size > self._held


class Reader:
    """Texts as one array of word numbers; equal words of different languages are different words."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words: list[tuple[str, bytes]] = [("", b""), ("", b"\n")]
        self.hashes = np.zeros(2, np.uint64)
        self._known: dict[str, dict[bytes, int]] = {}
        self._next = 2

    def numbers(self, batch: pa.RecordBatch, texts: list[bytes]) -> np.ndarray:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            by_lang.setdefault(lang, []).append(text)
        found = []
        for lang, some in by_lang.items():
            words = (b"\n".join(some) + b"\n").translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
            known = self._known.setdefault(lang, {b"": _NOTHING, b"\n": _END})
            fresh = list(set(words).difference(known))
            known.update(zip(fresh, range(self._next, self._next + len(fresh)), strict=True))
            self._next += len(fresh)
            seed = xxhash.xxh3_64_intdigest(lang.encode())
            self.words += [(lang, w) for w in fresh]
            self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in fresh), np.uint64, len(fresh))])
            numbers = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
            found.append(numbers[numbers != _NOTHING])
        return np.concatenate(found) if found else np.zeros(0, np.int32)


def _sorted_run(schema: pa.Schema, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A run in the order in which runs are merged."""
    keys = [k for k in ("m", *_KEY) if k in columns]
    order = np.lexsort([columns[k] for k in reversed(keys)])
    for at in range(0, len(order), 50_000):
        some = order[at : at + 50_000]
        arrays = [pa.array(columns[f.name][some], f.type) if f.name in columns else pa.nulls(len(some), f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lang_hash(lang: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(lang.encode())).astype(np.int64))


def _words_and_pairs(batches):
    """Counts of words, of word pairs within a piece, and of all words of a language (``m`` 1, 2 and 0)."""
    reader, trie = Reader(), HatTrie()
    counts = np.zeros(0, np.int64)

    def runs(everything: bool):
        for paths, n in trie.spill(everything):
            columns = {"m": np.full(len(n), 2, np.int32), "h1": _signed(reader.hashes[paths >> 32]), "h2": _signed(reader.hashes[paths & 0xFFFFFFFF]), "n": n}
            yield from _sorted_run(_SHORT, columns)

    def words():
        met = np.flatnonzero(counts[2:]) + 2
        totals: Counter = Counter()
        for at in range(0, len(met), 20_000):
            some = met[at : at + 20_000]
            held = [reader.words[i] for i in some.tolist()]
            n = counts[some]
            for (lang, _), x in zip(held, n.tolist(), strict=True):
                totals[lang] += x
            zeros = np.zeros(len(some), np.int64)
            texts = pa.array([w for _, w in held], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(zeros + 1, pa.int32()), pa.array(_signed(reader.hashes[some])), pa.array(zeros), pa.array(n), pa.array([lang for lang, _ in held], pa.string()), texts], schema=_SHORT
            )
        for lang, n in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((0, _lang_hash(lang), 0, n, lang, None), _SHORT, strict=True)], schema=_SHORT)

    for batch, texts in slices(batches):
        at = reader.numbers(batch, texts)
        more = np.bincount(at, minlength=len(reader.hashes))
        more[: len(counts)] += counts
        counts = more
        counts[:2] = 0
        within = (at[:-1] > _END) & (at[1:] > _END)
        trie.add(np.sort((at[:-1].astype(np.int64) << 32 | at[1:])[within]))
        if trie.full:
            yield from runs(False)
        if len(reader.words) > HELD_WORDS:
            yield from runs(True)
            yield from words()
            reader.clear()
            counts = np.zeros(0, np.int64)
    yield from runs(True)
    yield from words()


def _place(h1: np.ndarray, h2: np.ndarray, power: int) -> np.ndarray:
    """The bit of a word pair in a filter of ``2 ** power`` bits."""
    return mixed(h1 * np.uint64(0x9E3779B97F4A7C15) + h2) >> np.uint64(64 - power)


def _longer_phrases(power: int, bits) -> Callable:
    """Counts of three and four successive words all of whose pairs pass the filter."""

    def count(batches):
        reader, trie, pairs = Reader(), HatTrie(), Numbers()
        held = np.frombuffer(bits.value, np.uint8)

        def runs(everything: bool):
            ends = np.fromiter(pairs.keys(), np.int64, len(pairs))
            for paths, n in trie.spill(everything):
                first, second = ends[paths >> 32], ends[paths & 0x7FFFFFFF]
                four = (paths >> 31) & 1 == 1
                h = [_signed(reader.hashes[x]) for x in (first >> 32, first & 0xFFFFFFFF, np.where(four, second >> 32, second & 0xFFFFFFFF), second & 0xFFFFFFFF)]
                h[3] = np.where(four, h[3], 0)
                yield from _sorted_run(_LONG, {"m": np.where(four, 4, 3).astype(np.int32), **dict(zip(_KEY, h, strict=True)), "n": n})

        for batch, texts in slices(batches):
            at = reader.numbers(batch, texts)
            h = reader.hashes[at]
            spot = _place(h[:-1], h[1:], power)
            open_ = (at[:-1] > _END) & (at[1:] > _END) & ((held[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1)
            codes = (at[:-1].astype(np.int64) << 32 | at[1:])[open_].tolist()
            pair = np.full(len(open_), -1, np.int64)
            pair[open_] = np.fromiter(map(pairs.__getitem__, codes), np.int64, len(codes))
            three = open_[:-1] & open_[1:]
            four = three[:-1] & three[1:]
            paths = np.concatenate([(pair[:-1] << 32 | pair[1:])[three], (pair[:-2] << 32 | 1 << 31 | pair[2:])[four]])
            paths.sort()
            trie.add(paths)
            if trie.full:
                yield from runs(False)
            if len(reader.words) + len(pairs) > HELD_WORDS:
                yield from runs(True)
                reader.clear()
                pairs.clear()
        yield from runs(True)

    return count


def _merged(schema: pa.Schema, least: int) -> Callable:
    """Sums equal paths of the sorted runs that meet in a partition, and keeps those met ``least`` times."""
    keys = [i for i, f in enumerate(schema) if f.name in ("m", *_KEY)]
    at = schema.get_field_index("n")

    def merge(batches):
        last = None  # the open group: a batch of one row
        for batch in batches:
            if not len(batch):
                continue
            batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)
            table = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks().to_batches()[0]
            columns = [np.asarray(table.column(i)) for i in keys]
            new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(np.asarray(table.column(at)), starts)
            heads = table.take(pa.array(starts))
            heads = pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()) if i == at else heads.column(i) for i in range(len(schema))], schema=schema)
            last, done = heads.slice(len(heads) - 1), heads.slice(0, len(heads) - 1)
            yield from frequent(done)
        if last is not None:
            yield from frequent(last)

    def frequent(batch):
        keep = (np.asarray(batch.column(at)) >= least) | (np.asarray(batch.column(0)) == 0)
        if keep.any():
            yield batch.filter(pa.array(keep))

    return merge


def _counted(runs: DataFrame, schema: pa.Schema, least: int) -> DataFrame:
    """Runs dealt by the paths' first two words, merged in order there."""
    keys = [f.name for f in schema if f.name in ("m", *_KEY)]
    return runs.repartition("h1", "h2").sortWithinPartitions(*keys).mapInArrow(_merged(schema, least), _ddl(schema))


def _pair_filter(spark: SparkSession, pairs: DataFrame):
    """A bit field that holds every frequent pair (and, by chance, some others), of bounded size; built in slices by the tasks."""
    n = pairs.count()
    power = min(MOST_FILTER, max(LEAST_FILTER, int(16 * n).bit_length()))
    width = min(power, _SLICE_BITS)
    bit = pa.schema([("slice", pa.int32()), ("bit", pa.int32())])

    def spots(batches):
        for batch in batches:
            h1, h2 = (np.asarray(batch.column(i)).view(np.uint64) for i in range(2))
            spot = _place(h1, h2, power)
            columns = (spot >> np.uint64(width)).astype(np.int32), (spot & np.uint64((1 << width) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=bit)

    def fields(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            number, spot = (np.asarray(batch.column(i)) for i in range(2))
            for s in np.unique(number).tolist():
                field = held.setdefault(s, np.zeros(1 << width, bool))
                field[spot[number == s]] = True
        for s, field in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    out = bytearray(1 << (power - 3))
    made = pairs.select("h1", "h2").mapInArrow(spots, "slice int, bit int").repartition("slice").mapInArrow(fields, "slice int, bits binary")
    for row in made.collect():
        at = row["slice"] << (width - 3)
        out[at : at + len(row["bits"])] = row["bits"]
    return power, spark.sparkContext.broadcast(bytes(out))


def _key(*cells: str) -> list[Column]:
    return [F.col(c) if c else F.lit(0).cast("long") for c in (*cells, *[""] * (4 - len(cells)))]


def _cut_scores(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with ``l``, ``r`` and ``score`` of their lowest-scoring cut."""
    parts = []
    for m in (2, 3, 4):
        cuts = []
        for k in range(1, m):
            for side, cells in ((0, _KEY[:k]), (1, _KEY[k:m])):
                part = [F.lit(len(cells)).alias("pm"), *(c.alias(f"p{i}") for i, c in enumerate(_key(*cells), 1))]
                cuts.append(F.struct(F.lit(2 * k + side).alias("side"), *part))
        parts.append(phrases.where(F.col("m") == m).select("m", *_KEY, "n", F.explode(F.array(*cuts)).alias("part")).select("m", *_KEY, "n", "part.*"))
    every = parts[0].union(parts[1]).union(parts[2])
    known = counts.select(F.col("m").alias("pm"), *(F.col(h).alias(f"p{i}") for i, h in enumerate(_KEY, 1)), F.col("n").alias("f"))
    met = every.join(known, ["pm", "p1", "p2", "p3", "p4"])
    wide = met.groupBy("m", *_KEY, "n").agg(*(F.max(F.when(F.col("side") == s, F.col("f"))).alias(f"f{s}") for s in range(2, 8)))
    cuts = []
    for k in (1, 2, 3):
        left, right = f"f{2 * k}", f"f{2 * k + 1}"
        score = F.expr(f"cast(2000000 as decimal(8,0)) * cast(n as decimal(20,0)) div (cast({left} as decimal(20,0)) + cast({right} as decimal(20,0)))")
        cuts.append(F.when(F.col(left).isNotNull(), F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))))
    return wide.select("m", *_KEY, "n", F.array_min(F.array_compact(F.array(*cuts))).alias("cut")).select("m", *_KEY, "n", "cut.l", "cut.r", "cut.score")


def _unexplained(phrases: DataFrame, scored: DataFrame, share: int) -> DataFrame:
    """Candidates without a longer one around them that has at least ``share`` per cent of their occurrences."""
    inner = []
    for m, size in ((3, 2), (4, 2), (4, 3)):
        runs = [F.struct(F.lit(size).alias("m"), *(c.alias(h) for h, c in zip(_KEY, _key(*_KEY[k : k + size]), strict=True))) for k in range(m - size + 1)]
        inner.append(phrases.where(F.col("m") == m).select("n", F.explode(F.array(*runs)).alias("inner")).select("inner.*", "n"))
    around = inner[0].union(inner[1]).union(inner[2]).groupBy("m", *_KEY).agg(F.max("n").alias("around"))
    met = scored.join(around, ["m", *_KEY], "left")
    wide = "decimal(20,0)"
    explained = F.lit(100).cast("decimal(8,0)") * F.col("around").cast(wide) >= F.lit(share).cast("decimal(8,0)") * F.col("n").cast(wide)
    return met.where(~F.coalesce(explained, F.lit(False))).drop("around")


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, share: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's phrases of two to four words by how much they stick together: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words ``[^\\x20\\x09]+`` with A-Z lower-cased. Candidates occur ``least`` times (``a``); a cut into
    two parts met ``l`` and ``r`` times scores ``floor(2000000 a / (l + r))``, and the lowest cut counts (of equal ones, that with the shortest first part). Candidates inside a longer
    one with at least ``share`` per cent of their occurrences go. ``first``: so many of each language, by score and ``a`` (both descending) and phrase.
    ``n`` is the number of words of the language. NULL languages are ``und``, NULL texts empty; repeated rows count again; other columns are not read;
    an empty table gives no rows. A very long text is read whole.

    The first pass counts words and pairs, the second phrases of three and four words all of whose pairs occur ``least`` times (others cannot): each task counts in a trie that
    spills runs of 64-bit word hashes, so that a hot phrase is summed before it is shuffled, and runs are merged by their first two words. The pairs
    are known to the second pass by a bit field of at most 32 MB; what it lets through by chance is counted and dropped. A language is ranked in parts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    short = stage(_counted(rows.mapInArrow(_words_and_pairs, _ddl(_SHORT)), _SHORT, least), "short-phrases")
    pairs = short.where("m = 2").select("m", "h1", "h2", *(c.alias(h) for h, c in zip(_KEY[2:], _key(), strict=False)), "n")
    power, bits = _pair_filter(spark, pairs)
    long = stage(_counted(rows.mapInArrow(_longer_phrases(power, bits), _ddl(_LONG)), _LONG, least), "long-phrases")
    phrases = pairs.union(long)
    words = short.where("m = 1")
    counts = phrases.union(words.select("m", *_key("h1"), "n"))
    kept = stage(_unexplained(phrases, _cut_scores(phrases, counts), share), "candidates")
    spelt = words.select(F.col("h1").alias("h"), F.col("lang"), F.col("word"))
    places = kept.select("m", *_KEY, F.posexplode(F.slice(F.array(*_KEY), 1, F.col("m"))).alias("at", "h"))
    texts = places.join(spelt, "h").groupBy("m", *_KEY).agg(F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = kept.join(texts, ["m", *_KEY]).select("lang", F.array_join("words.word", " ").alias("phrase"), F.col("n").alias("a"), "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS))
    leading = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= first)
    ranked = leading.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = short.where("m = 0").select("lang", F.col("n").alias("total"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
