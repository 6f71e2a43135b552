"""The pipeline's stages on a small corpus, each against a plain reading of what it promises."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from slabmill.session import stage
from tests.llm.test_ngram_join import all_pairs
from tests.llm.test_odd_rows import brute_lines

WORDS = "the of and river stone light over under small great house garden walked quietly morning evening letter answer before after where there people".split()
ITEM = " ".join(random.Random(1).choices(WORDS, k=30))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    shared = "the river and the small stone of the garden walked over there before morning"
    rows = [(i, "\n".join(prose(rng.randrange(10, 40)) for _ in range(4)), "en", "web", 1) for i in range(150)]
    rows += [(200 + i, f"{prose(60)}\n{shared}", "en", "web", 1) for i in range(8)]
    rows += [(300 + i, rows[5][1] + (f" end{i}" if i else ""), "en", "web", 1) for i in range(4)]
    rows += [(400, f"{prose(40)} {ITEM} {prose(40)}", "en", "web", 1), (401, " ".join("#*$%&" * 6 + "XQZ" for _ in range(80)), "en", "web", 1), (402, None, None, None, None), (403, "", "en", "web", 0)]
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(401, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_stages(spark, folder):
    docs = corpus_pipeline.table(spark, folder, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    before = None
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, folder), name)
        old = [(r["doc_id"], r["text"], None) for r in before.collect()]
        if name != "best_fit_packing":
            assert docs.columns == before.columns
            new = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "quality_classifier":
            assert {d for d, _ in new} == {d for d, *_ in old} - {401}
        elif name == "line_dedup":
            assert sorted(new, key=repr) == sorted([(d, t) for d, _, _, t in brute_lines(old)], key=repr)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        elif name == "ngram_jaccard_join":
            assert {d for d, _ in new} == {c for _, _, c in all_pairs(old)} and len(new) < len(old)
        elif name == "benchmark_decontamination":
            assert {d for d, _ in new} == {d for d, *_ in old} - {400}
        else:
            assert {r["doc_id"] for r in docs.collect()} == {d for d, *_ in old}


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100


def test_columns_with_names_of_the_operators_pass_through(spark, folder):
    from pyspark.sql import functions as F

    docs = corpus_pipeline.table(spark, folder, "documents").limit(40)
    for c in ("kept", "hits", "n_lines", "row", "same", "id", "cut", "class", "perplexity"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, folder)
        assert after.columns == docs.columns, name
        assert after.where("kept != concat('kept', doc_id) or hits != concat('hits', doc_id) or same != concat('same', doc_id)").count() == 0, name


def test_empty_documents(spark, folder):
    none = corpus_pipeline.table(spark, folder, "documents").limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, none, folder).count() == 0, name
