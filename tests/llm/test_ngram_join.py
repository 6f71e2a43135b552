"""The near-copy join against all pairs, and what its guarantees rest on."""

from __future__ import annotations

import os
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from slabmill.llm import common, graph, ngram_join


def texts(seed: int, families: int, copies: int) -> list[tuple[int | None, str | None, str]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(vocabulary, k=12))
    rows: list[tuple[int | None, str | None, str]] = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 9, 14, 20, 40, 90, 200, 400]))
        for _ in range(rng.randrange(1, copies)):
            words = base[:]
            for _ in range(rng.randrange(0, max(1, len(words) // 18) + 1)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = words[: int(len(words) * rng.uniform(0.7, 1))] or words
            text = " ".join(words)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text + ("\n" + line if rng.random() < 0.3 else ""), "x"))
    return rows


def shingle_set(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def all_pairs(rows) -> list[tuple]:
    sets = [shingle_set(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    keys: dict[int, list] = {}
    for i, (d, _, _) in enumerate(rows):
        keys.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in keys.items()}
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _, _) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = texts(seed, 90, 9)
    got = ngram_join.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(all_pairs(rows))


def test_odd_rows(spark):
    long = "many words " * 20_000
    rows = [(5, "same words here", "a"), (5, "same words here", "a"), (3, " SAME\twords here ", "b"), (None, "same words here", "c"), (7, None, "d"), (8, "", "d"), (8, " \n", "d"),
            (9, long, "e"), (10, long + "x", "e"), (None, "alone in the world", "f"), (11, "alone in the world with key", "f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class string")
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, ngram_join.near_copy_groups(frame).collect()), key=order) == sorted(all_pairs(rows), key=order)
    kept = ngram_join.keep_one_of_each_group(frame)
    assert kept.columns == frame.columns
    assert Counter((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect()) == Counter(
        [(3, " SAME\twor"), (7, ""), (8, ""), (8, " \n"), (9, "many word"), (10, "many word"), (None, "alone in "), (11, "alone in ")]
    )
    assert ngram_join.near_copy_groups(frame.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = texts(4, 40, 8)
    kept = {r["doc_id"] for r in ngram_join.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)).collect()}
    assert kept == {component for _, _, component in all_pairs(rows)}


def test_sketch_distance_never_exceeds_the_symmetric_difference():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n, m, c = rng.integers(1, 200, 3)
        common = rng.integers(0, 2**63, c, dtype=np.uint64)
        a = np.unique(np.concatenate([rng.integers(0, 2**63, n, dtype=np.uint64), common]))
        b = np.unique(np.concatenate([rng.integers(0, 2**63, m, dtype=np.uint64), common]))
        x, y = (np.frombuffer(ngram_join.parity_sketch(s), np.uint64)[None, :] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        distance = int(np.bitwise_count(ngram_join._folded(x, width) ^ ngram_join._folded(y, width)).sum())
        assert distance <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("frequent", [False, True])
def test_linked_sets_always_share_a_selected_key(frequent):
    rng = np.random.default_rng(3)
    for trial in range(1500):
        n = int(rng.integers(1, 60)) if trial % 3 else int(rng.integers(60, 700))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        kept = a[rng.permutation(len(a))[: len(a) - int(rng.integers(0, len(a) // 4 + 1))]]
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, int(rng.integers(0, len(a) // 4 + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 4 * common < 3 * (len(a) + len(b) - common):
            continue
        known, level = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if frequent:
            known = np.unique(np.concatenate([k[::2] for k, _ in ngram_join.block_keys(a)]))
            level = (known % np.uint64(5)).astype(np.int64) + 3
        assert np.intersect1d(ngram_join._selected(a, known, level), ngram_join._selected(b, known, level)).size


@pytest.mark.parametrize("edges_per_task", [1_000_000, 40])
def test_components_of_chains_and_stars(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", edges_per_task)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(100, 400)] + [(5000 + 7 * i, 5000) for i in range(1, 5)] + [(9, 3), (3, 9), (2, 2)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    right = dict.fromkeys(range(61), 0) | dict.fromkeys([*range(100, 400), 1000], 100) | {5000 + 7 * i: 5000 for i in range(5)}
    assert got == right
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_task_gives_its_memory_back_after_its_last_row(monkeypatch):
    """Idle workers kept what earlier tasks had freed, which took an executor over its memory in the pipeline."""
    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append("back"))

    def work(given):
        for batch in given:
            told.append(batch.column(0)[0].as_py())
            yield batch

    assert list(common.sparing(work)(iter(batches))) == batches
    assert told == [0, 1, 2, "back"]


def test_give_back_returns_small_freed_strings_to_the_system():
    def resident() -> int:
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    held = [np.zeros(4000, np.uint64) for _ in range(2000)]  # 64 MB in pieces below malloc's mapping threshold
    for x in held:
        x += np.uint64(1)
    last = np.ones(4000, np.uint64)  # what is freed before it can't simply be cut off the heap's end
    del held, x
    before = resident()
    common.give_back()
    assert last.sum() == 4000
    assert resident() < before - (16 << 20)
