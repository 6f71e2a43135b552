"""LM scoring: a log-bilinear model over word classes, trained with noise-contrastive estimation in numpy."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabmill.llm.common import mixed, slices, small_batches, words_of
from slabmill.session import stage

#: Classes: 0 begins a text, the next ones are single frequent words, the rest share the other words by their endings.
CLASSES = 256
OWN_CLASSES = 128
DIMENSIONS = 24
ROUNDS = 3
#: Training parts: contexts are dealt to them by hash, and a part passes over its own so often in a round.
PARTS = 8
PASSES = 8
NOISE = 64
#: Contexts in a batch.
BATCH = 256
RATE = 0.05
#: Words whose counts every task holds: the most frequent ones of at most so many bytes. Others are joined with the counts.
HELD_WORDS = 80_000
HELD_BYTES = 48
#: The end of a text as a token; no word can be a line feed.
END = b"\n"
#: Distinct words that a task counts before it passes them on.
_FLUSH = 250_000
#: Text bytes that a task works on at once.
_AT_ONCE = 3 << 20

_WORDS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
_GRAMS = pa.schema([("part", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])
_PARAMETERS = pa.schema([("i", pa.int32()), ("value", pa.float64()), ("weight", pa.float64())])
_CLASS = pa.schema([("class", pa.int32()), ("tokens", pa.int64()), ("words", pa.int64())])
_TAIL = pa.struct([("word", pa.binary()), ("class", pa.int32()), ("n", pa.int64())])
_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("base_score", pa.float64()),
     ("score", pa.float64()), ("tail", pa.list_(_TAIL))]
)
_SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, base_score double, score double, tail array<struct<word: binary, class: int, n: bigint>>"


def ending_class(word: bytes) -> int:
    """The class of a word that has none of its own: by its last letters and whether punctuation follows them."""
    core = word.rstrip(b".,;:!?")
    return 1 + OWN_CLASSES + zlib.crc32(core[-3:] + (b"." if len(core) < len(word) else b"")) % (CLASSES - OWN_CLASSES - 1)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class Vocabulary(NamedTuple):
    """Training counts that are the same for every task; its size doesn't follow the corpus."""

    counts: dict[bytes, int]  # of the held words
    own: dict[bytes, int]  # word to class, for words that are a class
    tokens: int
    words: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def base(self, count: int) -> float:
        return math.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def within(self, own_class: int, count: int) -> float:
        """log10 P(word | class): 0 for a class of one word."""
        if own_class <= OWN_CLASSES:
            return 0.0
        return math.log10((count + 0.5) / (self.class_tokens[own_class] + 0.5 * (self.class_words[own_class] + 1)))

    def class_of(self, word: bytes) -> int:
        own = self.own.get(word)
        return ending_class(word) if own is None else own


class Parameters(NamedTuple):
    context: np.ndarray  # a vector for each class as context
    target: np.ndarray  # and as target
    near: np.ndarray  # how the vector of the word before acts
    far: np.ndarray  # and of the one before that
    bias: np.ndarray

    @classmethod
    def fresh(cls, log_unigram: np.ndarray) -> Parameters:
        rng = np.random.default_rng(11)
        draw = lambda: rng.normal(0, 0.1, (CLASSES, DIMENSIONS)).astype(np.float32)
        eye = np.eye(DIMENSIONS, dtype=np.float32)
        return cls(draw(), draw(), eye.copy(), 0.5 * eye, log_unigram.astype(np.float32))

    @classmethod
    def unpacked(cls, flat: np.ndarray) -> Parameters:
        shapes = [(CLASSES, DIMENSIONS)] * 2 + [(DIMENSIONS, DIMENSIONS)] * 2 + [(CLASSES,)]
        ends = np.cumsum([math.prod(s) for s in shapes])
        return cls(*(part.reshape(s).astype(np.float32) for part, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)))

    def packed(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self])

    def log10_table(self) -> np.ndarray:
        """log10 P(class | two classes before), normalised over the classes: a row for each pair, from batched matrix products."""
        near, far = self.context @ self.near, self.context @ self.far
        table = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
        for k in range(CLASSES):  # k: the class two before
            scores = (near + far[k]) @ self.target.T + self.bias
            scores[:, 0] = -np.inf  # nothing begins a text again
            top = scores.max(axis=1, keepdims=True)
            scores -= top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
            table[k * CLASSES : (k + 1) * CLASSES] = scores
        table *= np.float32(1 / math.log(10))
        return table


def train_nce(start: Parameters, codes: np.ndarray, counts: np.ndarray, log_noise: np.ndarray, seed: int, passes: int = 1) -> Parameters:
    """Passes over the class trigrams of a part (ascending codes): AdaGrad on the noise-contrastive loss.

    A batch is some contexts with the counts of what follows them. As classes are few, the loss takes the expectation over ``NOISE`` noise classes
    a word and not a sample of them, so a batch is three matrix products. A context weighs as the root of its count.
    """
    rng = np.random.default_rng(seed)
    p = Parameters(*(x.copy() for x in start))
    power = [np.full_like(x, 1e-6) for x in p]
    noise = (NOISE * np.exp(log_noise)).astype(np.float32)
    shift = np.log(noise)
    contexts, first = np.unique(codes >> 8, return_index=True)
    ends = np.append(first[1:], len(codes))
    order = np.concatenate([rng.permutation(len(contexts)) for _ in range(passes)])
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        n = ends[some] - first[some]
        row = np.repeat(np.arange(len(some)), n)
        place = np.arange(len(row)) + np.repeat(first[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        follows = np.zeros((len(some), CLASSES), np.float32)
        follows[row, codes[place] & 255] = counts[place]
        total = follows.sum(axis=1, keepdims=True)
        weight = np.sqrt(total)
        weight /= weight.sum()
        far, near = contexts[some] >> 8, contexts[some] & 255
        rf, rn = p.context[far], p.context[near]
        hidden = rn @ p.near + rf @ p.far
        true = 1 / (1 + np.exp(np.clip(shift - p.bias - hidden @ p.target.T, -30, 30)))
        gain = weight * (follows / total * (1 - true) - noise * true)
        d_hidden = gain @ p.target
        d_context = np.zeros_like(p.context)
        np.add.at(d_context, near, d_hidden @ p.near.T)
        np.add.at(d_context, far, d_hidden @ p.far.T)
        for x, g, s in zip(p, (d_context, gain.T @ hidden, rn.T @ d_hidden, rf.T @ d_hidden, gain.sum(axis=0)), power, strict=True):
            s += g * g
            x += RATE * g / np.sqrt(s)
    return p


def _word_counts(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=_WORDS)
            counts.clear()

        for batch, texts in slices(batches, size=_AT_ONCE):
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if not is_held_out(key):
                    counts.update(words_of(text.lower()))
                    counts[END] += 1
            if len(counts) >= _FLUSH:
                yield from flushed()
        if counts:
            yield from flushed()

    return docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame) -> Vocabulary:
    tokens, words = counts.agg(F.sum("n"), F.count("*")).first()
    held = counts.where(F.octet_length("word") <= HELD_BYTES).orderBy(F.desc("n"), "word").limit(HELD_WORDS).collect()
    ends = counts.where(F.col("word") == F.lit(END)).select("n").first()
    known = {bytes(r["word"]): r["n"] for r in held} | ({END: ends["n"]} if ends else {})
    frequent = [bytes(r["word"]) for r in held[:OWN_CLASSES] if bytes(r["word"]) != END][: OWN_CLASSES - 1]
    own = {w: i + 1 for i, w in enumerate(frequent)} | {END: OWN_CLASSES}  # the end is always a class of its own

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            words_here = batch.column(0).to_pylist()
            found = np.fromiter((own[w] if w in own else ending_class(w) for w in words_here), np.int64, len(words_here))
            total += np.bincount(found, batch.column(1).to_numpy(), CLASSES).astype(np.int64)
            distinct += np.bincount(found, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((range(CLASSES), total, distinct), _CLASS, strict=True)], schema=_CLASS)

    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    sums = counts.select("word", "n").mapInArrow(classes, "class int, tokens long, words long").groupBy("class").agg(F.sum("tokens"), F.sum("words"))
    for k, n, v in sums.collect():
        class_tokens[k], class_words[k] = n, v
    return Vocabulary(known, own, tokens or 0, words, class_tokens, class_words)


def _trigrams(docs: DataFrame, shared) -> DataFrame:
    """Class trigrams of the training texts with their counts, packed by task and training part; bounded by 256^3 a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = shared.value, np.zeros(CLASSES**3, np.int32)
        for batch, texts in slices(batches, size=_AT_ONCE):
            words = [words_of(t.lower()) for k, t in zip(batch.column(0).to_pylist(), texts, strict=True) if not is_held_out(k)]
            if words:
                class_of = {w: v.class_of(w) for w in set().union(*words)}
                flat = np.fromiter(map(class_of.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
                here = _class_sequences(words, flat, v)[0]
                codes, n = np.unique((here[:-2] << 16 | here[1:-1] << 8 | here[2:])[here[2:] != 0], return_counts=True)
                total[codes] += n.astype(np.int32)
        codes = np.flatnonzero(total)
        part = part_of(codes)
        for k in range(PARTS):
            mine = codes[part == k]
            for at in range(0, len(mine), 1 << 19):
                some = mine[at : at + (1 << 19)]
                columns = [pa.array([k], pa.int32()), pa.array([some.astype("<i4").tobytes()]), pa.array([total[some].astype("<i8").tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, schema=_GRAMS)

    return docs.mapInArrow(count, "part int, codes binary, counts binary")


def part_of(codes: np.ndarray) -> np.ndarray:
    """Training parts of class trigrams: by a hash of the context, so that parts are alike and a context is in one of them."""
    return (mixed((codes >> 8).astype(np.uint64)) % np.uint64(PARTS)).astype(np.int64)


def _merged(grams: DataFrame) -> DataFrame:
    """One row a training part, with the counts of all tasks summed by trigram."""

    def merge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = np.arange(CLASSES**2) << 8
        contexts = contexts[part_of(contexts) == key[0].as_py()]
        place = np.zeros(CLASSES**2, np.int64)
        place[contexts >> 8] = np.arange(len(contexts))
        total = np.zeros((len(contexts), CLASSES), np.int64)
        for table in tables:
            for codes, counts in zip(table.column(1).to_pylist(), table.column(2).to_pylist(), strict=True):
                codes = np.frombuffer(codes, "<i4")
                total[place[codes >> 8], codes & 255] += np.frombuffer(counts, "<i8")
        row, last = np.nonzero(total)
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([(contexts[row] | last).astype("<i4").tobytes()]), pa.array([total[row, last].astype("<i8").tobytes()])]
        yield pa.RecordBatch.from_arrays(columns, schema=_GRAMS)

    return grams.groupBy("part").applyInArrow(merge, "part int, codes binary, counts binary")


def _class_sequences(words: list[list[bytes]], classes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Classes of texts one after another, each as two begins, its words' classes and its end; and where each text begins."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate([[0], np.cumsum(lengths + 3)])
    out = np.zeros(int(begins[-1]), np.int64)
    out[np.arange(len(classes)) + np.repeat(3 * np.arange(len(words)) + 2, lengths)] = classes
    out[begins[1:] - 1] = v.own[END]
    return out, begins[:-1]


def _train(grams: DataFrame, v: Vocabulary) -> Parameters:
    """Rounds of parallel passes: each part trains from the same parameters, and the results are averaged by their tokens."""
    sc = grams.sparkSession.sparkContext
    share = v.class_tokens + 1.0
    share[0] = 1e-3
    log_noise = np.log(share / share.sum())
    p = Parameters.fresh(log_noise)
    for r in range(ROUNDS):
        start = sc.broadcast(p)

        def step(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for codes, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    codes, counts = np.frombuffer(codes, "<i4").astype(np.int64), np.frombuffer(counts, "<i8")
                    found = train_nce(start.value, codes, counts, log_noise, int(codes.sum() % (1 << 31)) + r, PASSES).packed().astype(np.float64)
                    weight = np.full(len(found), float(counts.sum()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((np.arange(len(found)), found * weight, weight), _PARAMETERS, strict=True)], schema=_PARAMETERS)

        sums = grams.mapInArrow(step, "i int, value double, weight double").groupBy("i").agg(F.sum("value"), F.sum("weight")).toArrow()
        if sums.num_rows:
            i, value, weight = (c.to_numpy() for c in sums.columns)
            flat = np.zeros(len(p.packed()))
            flat[i] = value / weight
            p = Parameters.unpacked(flat)
    return p


def _scored(docs: DataFrame, shared) -> DataFrame:
    """Scores of the held words of each text, and its other words with their counts in the text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value
        table = p.log10_table()
        end = v.base(v.counts.get(END, 0))
        for batch, texts in slices(batches, size=_AT_ONCE):
            words = [words_of(t.lower()) for t in texts]
            number = {w: i for i, w in enumerate(set().union(*words))}
            of_word = np.fromiter(map(v.class_of, number), np.int64, len(number))
            held = [v.counts.get(w) for w in number]
            known = np.array([n is not None for n in held], bool)
            base = np.array([0.0 if n is None else v.base(n) for n in held])
            within = np.array([0.0 if n is None else v.within(k, n) for n, k in zip(held, of_word.tolist(), strict=True)])
            flat = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
            classes, begins = _class_sequences(words, of_word[flat], v)
            predicted = table[classes[:-2] << 8 | classes[1:-1], classes[2:]]
            predicted[classes[2:] == 0] = 0
            lbl = np.add.reduceat(predicted, begins, dtype=np.float64)
            ends = np.cumsum([0, *map(len, words)])
            sums = [np.concatenate([[0.0], np.cumsum(x[flat])]) for x in (base, within)]
            own_base, own_within = (x[ends[1:]] - x[ends[:-1]] for x in sums)
            listed, rows = list(number), []
            for i, key in enumerate(batch.column(0).to_pylist()):
                here = flat[ends[i] : ends[i + 1]]
                rare, n = np.unique(here[~known[here]], return_counts=True)
                tail = [{"word": listed[w], "class": k, "n": m} for w, k, m in zip(rare.tolist(), of_word[rare].tolist(), n.tolist(), strict=True)]
                rows.append((key, is_held_out(key), len(here) + 1, own_base[i] + end, own_within[i] + lbl[i], tail))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCORED, strict=True)], schema=_SCORED)

    return docs.mapInArrow(score, _SCORED_SQL)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; no other column is read.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and one end a text (NULL: an empty text, its end only). Rows whose crc32 of
    the key as text leaves 1 modulo 5 are held out, all others train (a NULL key as an empty text: trains). ``base_score`` is the smoothed unigram's log10
    probability. The model is P(class | two classes before) of a log-bilinear model times P(word | class) of smoothed counts, both
    normalised, so ``score`` is the log10 probability of the whole text.

    Word counts, class totals and class trigrams cover all training rows. A task holds the counts of the ``HELD_WORDS`` most frequent words only; each
    text's other words are joined with the full counts and summed back by row. Training is by rounds of averaged parallel
    passes over trigram counts summed over all tasks and dealt to parts by context; what goes to the driver in a round is one set of parameters.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = stage(_word_counts(rows), "word-counts")
    v = _vocabulary(counts)
    p = _train(stage(_merged(_trigrams(rows, spark.sparkContext.broadcast(v))), "class-trigrams"), v)
    scored = stage(_scored(rows, spark.sparkContext.broadcast((v, p))).withColumn("row", F.monotonically_increasing_id()), "scored")

    denominator = F.lit(v.tokens + 0.5 * (v.words + 1))
    of_class = F.element_at(F.array(*(F.lit(float(t + 0.5 * (w + 1))) for t, w in zip(v.class_tokens, v.class_words, strict=True))), F.col("class") + 1)
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.*").withColumnRenamed("n", "here")
    count = F.coalesce("n", F.lit(0)) + 0.5
    sums = (
        tail.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("here") * F.log10(count / denominator)).alias("base"),
            F.sum(F.col("here") * F.log10(count / of_class)).alias("model"),
            F.sum(F.when(F.col("n").isNull(), F.col("here"))).alias("unknown"),
        )
    )
    none = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("tail").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_tokens") - none("unknown") - F.lit(0 if END in v.counts else 1)).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + none("base")).alias("base_score"), (F.col("score") + none("model")).alias("score"),
    )
