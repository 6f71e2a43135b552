"""Quality rules as a short-circuit cascade: the rule that rejects most for its cost runs first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabmill.llm.common import slices, small_batches, words_of

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Longer texts are not in the sample that orders the rules.
SAMPLE_CHARS = 20_000
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"


def _count(text: bytes, kinds: bytes) -> int:
    return len(text) - len(text.translate(None, kinds))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five words that are found twice or more in the text, first ones included.

    Exact: a window is the number that its words' ranks spell; where the number would be too large, pairs are ranked first.
    """
    n, distinct = len(words), set(words)
    if n <= WINDOW or len(distinct) == n:
        return 0
    rank = dict(zip(distinct, range(len(distinct)), strict=True))
    ids, base = np.fromiter(map(rank.__getitem__, words), np.int64, n), len(distinct)
    if base**WINDOW < 1 << 63:
        window = ids[: n - 4]
        for k in range(1, WINDOW):
            window = window * base + ids[k : n - 4 + k]
    else:
        pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        fours = np.unique(pairs[:-2] * (int(pairs.max()) + 1) + pairs[2:], return_inverse=True)[1]
        window = fours[:-1] * base + ids[4:]
    ordered = np.sort(window)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(window, twice))
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


class Text:
    """One text and what rules measure of it; each measure is taken when a rule first asks for it."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.raw)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        chars = len(self.raw) if self.raw.isascii() else len(self.raw.decode())
        return chars - _count(self.raw, WHITE)

    @cached_property
    def n_symbols(self) -> int:
        return _count(self.raw, SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_upper(self) -> int:
        return _count(self.raw, UPPER)

    @cached_property
    def n_lower(self) -> int:
        return _count(self.raw, LOWER)

    @cached_property
    def n_stutters(self) -> int:
        return sum(map(bytes.__eq__, self.words, self.words[1:]))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


def base_failed(t: Text) -> bool:
    return t.n_words < 10 or 100 * t.n_repeat_words > 20 * t.n_words


#: The thresholds leave a wide margin to clean prose of any length and language.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("exclaiming", lambda t: 10 * t.raw.count(b"!") > 2 * t.n_words),
    Rule("shouting", lambda t: 10 * t.n_upper > 4 * (t.n_upper + t.n_lower)),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 5 * len(t.lines)),
    Rule("stuttering", lambda t: 10 * t.n_stutters > 2 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("digits", lambda t: 10 * _count(t.raw, DIGITS) > 5 * t.word_chars),
)

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OUT = "id long, " + ", ".join(f"{m} long" for m in _MEASURES) + ", base_failed boolean, kept boolean, rejected_by string"
_SCHEMA = pa.schema([("id", pa.int64()), *((m, pa.int64()) for m in _MEASURES), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])
_COSTS = pa.schema([("rule", pa.int64()), ("seconds", pa.float64()), ("rejected", pa.int64())])


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int, text: str = "text") -> list[int]:
    """Rule numbers by rejections per second on at most ``sample_rows`` rows of at most ``SAMPLE_CHARS``; costs include the measures that a rule takes.

    The rows are the first that a scan meets, so a large table isn't read for them. The order decides how soon a bad text is done with, never which texts are kept.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected = [0.0] * len(rules), [0] * len(rules)
        for _, texts in slices(batches):
            for raw in texts:
                if raw and not base_failed(Text(raw)):
                    for i, rule in enumerate(rules):
                        began = time.perf_counter()
                        rejected[i] += rule.rejects(Text(raw))
                        seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((range(len(rules)), seconds, rejected), _COSTS, strict=True)], schema=_COSTS)

    some = docs.select(F.col(text).alias("text")).where(F.char_length("text") <= SAMPLE_CHARS).take(sample_rows)
    costs = docs.sparkSession.createDataFrame(some, "text string").mapInArrow(weigh, "rule long, seconds double, rejected long")
    found = costs.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    value = {r["rule"]: r["r"] / max(r["s"], 1e-9) for r in found}
    return sorted(range(len(rules)), key=lambda i: (-value.get(i, 0.0), i))


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the base measures, ``base_failed``, ``kept`` and ``rejected_by`` of every row; no other column is read.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` of the whole text (NULL: none). A text that fails the base goes; any other text meets the rules in the
    order of :func:`cascade_order` and the first that rejects it ends its cascade. ``rejected_by`` is ``base``, that rule's
    name, or NULL. Rows are judged one by one, so NULL or repeated keys don't matter, and nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    order = [rules[i] for i in cascade_order(docs, rules, sample_rows, text)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            rows = []
            for raw in texts:
                t = Text(raw)
                failed = base_failed(t)
                by = "base" if failed else next((r.name for r in order if r.rejects(t)), None)
                rows.append((*(getattr(t, m) for m in _MEASURES), failed, by is None, by))
            columns = [batch.column(0), *zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(judge, _OUT).withColumnRenamed("id", key)
