"""A training corpus from raw documents: quality classifier, line dedup, near copies, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slabmill.llm import decontam, kneser_ney, line_dedup, ngram_join, packing
from slabmill.llm.common import table
from slabmill.llm.tokens import CUT_BYTES, public_tokenizer
from slabmill.session import stage


#: Bytes in each generation of the last stage's encoder: by then the JVM of an executor has grown to all it may take.
PACKING_REMEMBERED = 16 << 20


def whole_rows(docs: DataFrame) -> DataFrame:
    """What the operators read, and the row's other columns as they came: columns of any name pass through, and a text is there once."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else [F.lit(None).cast("string").alias("lang")]), F.struct(*others).alias("whole"))


def as_before(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that ``whole_rows`` was given, with those that a stage changed."""
    return rows.select(*(changed.get(c, F.col("text") if c == "text" else F.col("whole")[c]).alias(c) for c in columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limits of trusted text of their language."""
    return as_before(kneser_ney.classify(whole_rows(docs), table(spark, sf_dir, "labels")).where("kept"), docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that another one keeps; ``n_chars``, where there is one, is that of the text left."""
    return as_before(line_dedup.dedup_lines(whole_rows(docs)), docs.columns, n_chars=F.char_length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return as_before(decontam.with_benchmark_hits(whole_rows(docs), table(spark, sf_dir, "benchmark")).where("hits is null"), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces placed in sequences of 4096 tokens."""
    placed = packing.pack_documents(docs, public_tokenizer("word_bpe_49k.json"), end_id=1, remember=PACKING_REMEMBERED, cut=CUT_BYTES)
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", shared_lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted models and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
