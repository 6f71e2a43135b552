"""Spelling variants: k-d trees over letter counts find the words that are one edit apart.

A word's letter counts are written in unary: bit ``(g, t)`` says that the word holds at least ``t`` letters of group ``g`` (26 letters, six groups
of others; ``t`` from 1 to 4). One inserted letter sets at most one bit and one deleted letter clears at most one, so words one edit apart differ
by at most one bit set and one cleared (an L1 distance of at most two), and a k-d cut "count of ``g`` at least ``t``" is one bit.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabmill.llm.common import slices, small_batches
from slabmill.session import stage

#: Code points of a word in Latin-1: A-Z lower-cased, U+00C0 to U+00FF kept, all others a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
GROUPS, STEPS = 32, 4
#: Words that a task counts before it passes them on.
COUNTED_WORDS = 400_000
#: Words, and bytes of words, that one leaf of the tree over all tasks is meant to hold, and words of a leaf of a task's own tree.
LEAF_WORDS, LEAF_BYTES, BUCKET = 4096, 4 << 20, 48
#: Words (in the mean) whose letter counts the driver cuts the lengths by; they set the balance of the tasks only.
SAMPLED_WORDS = 40_000
#: Letters cleared and set on the way to a near word, by how much longer that is.
BUDGETS = {-1: (1, 0), 0: (1, 1), 1: (0, 1)}

_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_ROUTED = pa.schema([("length", pa.int32()), ("leaf", pa.int32()), ("asked", pa.bool_()), ("word", pa.binary()), ("n", pa.int64())])
_FOUND = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _told(words: list[bytes]) -> list[str]:
    return [w.decode("latin-1") for w in words]


def words_of_document(key: object, text: bytes, spoilt: int, least: int) -> Iterator[tuple[bytes, int]]:
    """Words (Latin-1) of at least ``least`` letters with their counts; where ``spoilt`` divides the crc32 of ``key:word``, one letter is gone."""
    before, counts = zlib.crc32(b":" if key is None else b"%d:" % key), defaultdict(int)
    for word in text.decode().encode("latin-1", "replace").translate(_LETTERS).split():
        if len(word) >= least:
            counts[word] += 1
    for word, n in counts.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), before)
        if h % spoilt == 0:
            word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) < least:
                continue
        yield word, n


def count_words(docs: DataFrame, least_letters: int, least_count: int, spoilt: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and its occurrences ``n`` over all texts, summed in the tasks before they are shuffled."""

    def count(batches):
        found: dict[bytes, int] = defaultdict(int)
        for batch, texts in slices(batches):
            for k, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                for word, n in words_of_document(k, t, spoilt, least_letters):
                    found[word] += n
            if len(found) > COUNTED_WORDS:
                yield _batch(_COUNTED, _told(list(found)), list(found.values()))
                found.clear()
        yield _batch(_COUNTED, _told(list(found)), list(found.values()))

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_bits(words: list[bytes]) -> np.ndarray:
    """Unary letter counts of each word: two 64-bit numbers."""
    if not words:
        return np.zeros((0, 2), np.uint64)
    letters = np.frombuffer(b"".join(words), np.uint8)
    group = np.where(letters < 0xC0, letters - 97, 26 + letters % 6).astype(np.int64)
    owner = np.repeat(np.arange(len(words), dtype=np.int64), [len(w) for w in words])
    counts = np.bincount(owner * GROUPS + group, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return np.packbits((counts[:, :, None] > np.arange(STEPS)).reshape(len(words), -1), axis=1, bitorder="little").view(np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[..., 0]) + np.bitwise_count(x[..., 1])


def _cutting_bit(bits: np.ndarray) -> int | None:
    """The bit that halves the points best, or none where all points are alike."""
    share = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little").mean(axis=0)
    best = int(np.abs(share - 0.5).argmin())
    return best if 0 < share[best] < 1 else None


def _has(bits: np.ndarray, bit: int) -> np.ndarray:
    return (bits[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) == 1


class Cuts:
    """The upper part of one length's tree, shared by all tasks: numbered leaves, in blocks where letters alone cannot cut them."""

    def __init__(self, bits: np.ndarray, weight: float, capacity: float):
        self._leaves = 0
        self._root = self._cut(bits, weight, capacity)

    def _cut(self, bits: np.ndarray, weight: float, capacity: float) -> tuple:
        bit = _cutting_bit(bits) if len(bits) * weight > capacity and len(bits) > 8 else None
        if bit is None:
            blocks = max(1, int(len(bits) * weight / (2 * capacity)))
            self._leaves += blocks
            return (None, self._leaves - blocks, blocks)
        there = _has(bits, bit)
        return (bit, self._cut(bits[~there], weight, capacity), self._cut(bits[there], weight, capacity))

    def home(self, bits: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The leaf that holds each point."""
        out, todo = np.zeros(len(bits), np.int32), [(self._root, np.arange(len(bits)))]
        while todo:
            (bit, low, high), at = todo.pop()
            if bit is None:
                out[at] = low + salt[at] % high
            else:
                there = _has(bits[at], bit)
                todo += [(low, at[~there]), (high, at[there])]
        return out

    def reached(self, bits: np.ndarray, cleared: int, set_: int) -> Iterator[tuple[np.ndarray, int]]:
        """(points, leaf) wherever a near word may be: bits that a leaf wants otherwise use up the budgets of cleared and set ones."""
        n = len(bits)
        todo = [(self._root, np.arange(n), np.full(n, cleared, np.int8), np.full(n, set_, np.int8))]
        while todo:
            (bit, low, high), at, down, up = todo.pop()
            if not len(at):
                continue
            if bit is None:
                for block in range(high):
                    yield at, low + block
                continue
            there = _has(bits[at], bit)
            down, up = down.astype(np.int8), up.astype(np.int8)
            for node, spent_down, spent_up in ((low, there, None), (high, None, ~there)):
                left_down = down - spent_down if spent_down is not None else down
                left_up = up - spent_up if spent_up is not None else up
                ok = (left_down >= 0) & (left_up >= 0)
                todo.append((node, at[ok], left_down[ok], left_up[ok]))


class LetterTree:
    """Words of one length in a k-d tree whose nodes know the box of their letter counts."""

    def __init__(self, words: list[bytes], counts: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n = [words[i] for i in order], np.array([counts[i] for i in order], np.int64)
        self._bits = letter_bits(self.words)
        self._letters = np.frombuffer(b"".join(self.words), np.uint8).reshape(len(words), -1) if words else np.zeros((0, 0), np.uint8)
        self._root = self._node(np.arange(len(words))) if words else None

    def _node(self, at: np.ndarray) -> tuple:
        bits = self._bits[at]
        low, high = np.bitwise_and.reduce(bits), np.bitwise_or.reduce(bits)
        bit = _cutting_bit(bits) if len(at) > BUCKET else None
        if bit is None:
            return (low, high, at, None)
        there = _has(bits, bit)
        return (low, high, self._node(at[~there]), self._node(at[there]))

    def near(self, asked: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index in ``asked``, index in ``words``) one edit apart; words of ``asked`` have one length."""
        if not asked or self._root is None:
            return
        length = self._letters.shape[1]
        cleared, set_ = BUDGETS[length - len(asked[0])]
        bits, letters = letter_bits(asked), np.frombuffer(b"".join(asked), np.uint8).reshape(len(asked), -1)
        todo = [(self._root, np.arange(len(asked)))]
        while todo:
            (low, high, first, second), at = todo.pop()
            q = bits[at]
            at = at[(_ones(low & ~q) <= set_) & (_ones(q & ~high) <= cleared)]
            if not len(at):
                continue
            if second is not None:
                todo += [(first, at), (second, at)]
                continue
            for start in range(0, len(first), 4096):  # more than a few only where letter counts are all alike
                yield from self._compared(bits, letters, at, first[start : start + 4096], cleared, set_)

    def _compared(self, bits: np.ndarray, letters: np.ndarray, at: np.ndarray, some: np.ndarray, cleared: int, set_: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        points = self._bits[some]
        step = max(1, 200_000 // len(some))
        for start in range(0, len(at), step):
            part = at[start : start + step]
            q = bits[part][:, None, :]
            ok = (_ones(points & ~q) <= set_) & (_ones(q & ~points) <= cleared)
            mine, other = np.nonzero(ok)
            x, y = part[mine], some[other]
            size = max(1, (4 << 20) // max(1, self._letters.shape[1]))
            for a in range(0, len(x), size):
                i, j = x[a : a + size], y[a : a + size]
                true = one_edit(letters[i], self._letters[j])
                if true.any():
                    yield i[true], j[true]


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words (rows of letters) differ by exactly one replaced letter, or by one letter that the longer one has more."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    if x.shape[1] > y.shape[1]:
        x, y = y, x
    front = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= x.shape[1]


def _cuts_by_length(words: DataFrame) -> dict[int, Cuts]:
    n = words.count()
    share = min(1.0, SAMPLED_WORDS / max(1, n))
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word")
    by_length = defaultdict(list)
    for (word,) in sample.collect():
        by_length[len(word)].append(word.encode("latin-1"))
    return {size: Cuts(letter_bits(sorted(some)), 1 / share, min(LEAF_WORDS, max(1, LEAF_BYTES // size))) for size, some in by_length.items()}


def _route(cuts: dict[int, Cuts]):
    """Each word to the leaf that holds it, and as a question to all leaves of three lengths where near words may be."""
    alone = Cuts(np.zeros((0, 2), np.uint64), 1, 1)

    def route(batches):
        for batch in batches:
            counts, by_length = np.asarray(batch.column(1)), defaultdict(list)
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for i, w in enumerate(words):
                by_length[len(w)].append(i)
            for size, at in by_length.items():
                some, n = [words[i] for i in at], counts[at]
                held, bits = pa.array(some, pa.binary()), letter_bits(some)
                salt = np.fromiter(map(zlib.crc32, some), np.int64, len(some))
                home = cuts.get(size, alone).home(bits, salt)
                yield _batch(_ROUTED, np.full(len(at), size, np.int32), home, pa.array(np.zeros(len(at), bool)), held, n)
                for longer, (cleared, set_) in BUDGETS.items():
                    for asked, leaf in cuts.get(size + longer, alone).reached(bits, cleared, set_):
                        yield _batch(_ROUTED, np.full(len(asked), size + longer, np.int32), np.full(len(asked), leaf, np.int32), pa.array(np.ones(len(asked), bool)), held.take(pa.array(asked)), np.zeros(len(asked), np.int64))

    return route


def _answer(tree: LetterTree, asked: list[bytes]) -> Iterator[pa.RecordBatch]:
    """For each asked word with near words in the tree: how many, and the most frequent (of equal ones the smallest)."""
    by_length = defaultdict(list)
    for w in asked:
        by_length[len(w)].append(w)
    for same in by_length.values():
        pairs = list(tree.near(same))
        if not pairs:
            continue
        x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
        order = np.lexsort((y, -tree.n[y], x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        best = y[first]
        near = np.diff(np.r_[first, len(x)])
        yield _batch(_FOUND, _told([same[i] for i in x[first]]), near, tree.n[best], _told([tree.words[i] for i in best]))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (length, leaf, asked): the words of a leaf, then the questions to it, which stream past."""
    place, words, counts, tree = None, [], [], None
    for batch in batches:
        length, leaf, asked = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        edges = np.flatnonzero((length[1:] != length[:-1]) | (leaf[1:] != leaf[:-1]) | (asked[1:] != asked[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
            if a == b:
                continue
            if place != (length[a], leaf[a]):
                place, words, counts, tree = (length[a], leaf[a]), [], [], None
            some = batch.column(3).slice(a, b - a).to_pylist()
            if not asked[a]:
                words += some
                counts += batch.column(4).slice(a, b - a).to_pylist()
                continue
            if tree is None:
                tree = LetterTree(words, counts)
            for at in range(0, len(some), 2000):
                yield from _answer(tree, some[at : at + 2000])


def near_words(words: DataFrame) -> DataFrame:
    """For each word of ``words`` (distinct ``word`` in Latin-1 letters, ``n``; best a stored table) with near ones: ``n_near``, and ``best``, ``best_n`` of the most frequent.

    One k-d tree a length is cut into leaves of about ``LEAF_WORDS`` words. A word goes to its leaf, and as a question to the leaves of its own length and
    of the two lengths beside it whose box lies within its budget; there a task's own tree is searched, and letters in order decide. A leaf that
    letter counts cannot cut is dealt in blocks. Each pair is met once from either side, and one row a (word, leaf) returns.
    """
    spark = words.sparkSession
    small_batches(spark)
    route = _route(_cuts_by_length(words))
    routed = words.select("word", "n").mapInArrow(route, "length int, leaf int, asked boolean, word binary, n long")
    dealt = routed.repartition("length", "leaf").sortWithinPartitions("length", "leaf", "asked")
    found = dealt.mapInArrow(_searched, "word string, near long, best_n long, best string")
    most = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), most.alias("most")).select("word", "n_near", F.col("most.best").alias("best"), (-F.col("most.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for every row of ``forms`` (``word``, ``form``; without cycles): each round doubles the way that is followed."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stage(now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, ratio: int = 5, spoilt: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word of the corpus with the more frequent word it is probably a spelling of: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of at least ``least_letters`` letters and ``least_count`` occurrences. ``form`` is
    the most frequent word one edit away (of equal ones the smallest), where it is at least ``ratio`` (2 or more) times as frequent; ``root`` is where the forms lead.
    ``spoilt``: where it divides the crc32 of ``key:word``, one letter of that document's word is taken out before counting.

    NULL texts hold no words, a NULL key is written as nothing before the colon, repeated rows count again, an empty table gives no rows, other columns
    are not read. Very long texts and words are read whole; leaves of long words hold fewer of them.
    """
    if ratio < 2:
        raise ValueError("ratio below 2: two words could be each other's form")
    small_batches(docs.sparkSession)
    words = stage(count_words(docs, least_letters, least_count, spoilt, key, text), "words")
    met = words.join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    judged = stage(
        met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms"
    )
    led = roots(judged.where("form is not null"))
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
