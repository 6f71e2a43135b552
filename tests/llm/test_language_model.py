"""Training of the language model: the same whatever tasks the texts lie in, each context in one part."""

from __future__ import annotations

import random

import numpy as np

from slabmill.llm import language_model


def test_scores_do_not_depend_on_the_tasks(spark):
    rng = random.Random(8)
    words = [f"w{i}{e}" for i in range(60) for e in ("ing", "ed", "s,", "er")]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=80))) for i in range(400)], "doc_id long, text string")
    few, many = ({r["doc_id"]: r["score"] for r in language_model.score_texts(docs.repartition(n, "doc_id")).collect()} for n in (1, 7))
    assert len(few) == 400 and all(abs(few[k] - many[k]) < 0.01 for k in few)


def test_parts_hold_whole_contexts_of_every_class():
    codes = np.arange(0, 1 << 24, 3)
    part = language_model.part_of(codes)
    order = np.argsort(codes >> 8, kind="stable")
    same = (codes[order][1:] >> 8) == (codes[order][:-1] >> 8)
    assert (part[order][1:] == part[order][:-1])[same].all()
    for k in range(language_model.PARTS):  # no class two before is in some parts only
        assert len(np.unique(codes[part == k] >> 16)) == 256
