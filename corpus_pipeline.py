"""A corpus pipeline of five stages over ``documents``; part of ``lodestone.llm``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps. ``run`` writes
it as Parquet to the shared folder, and the next stage reads it from there.

All stages: null texts are empty; rows without doc_id and rows that are repeated are kept or dropped as their
text demands; an empty table gives an empty table; other columns, whatever their names, stay as they are
(but for what a stage says that it changes); texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, line_dedup, pu_quality, replication, winnowing
from lodestone.llm.shared import written

#: Near duplicates: words of a shingle, and the similarity (den / num) from which texts link.
SHINGLE_WORDS, NUM, DEN = 5, 100, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go.

    Repeated rows score alike. Without a positive label all score 0.5, and go; empty texts are judged like others.
    """
    return pu_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents or more stay in the last one only; n_chars follows the text.

    No row goes. A null text becomes an empty one. Rows without doc_id are one document, below all others.
    """
    cut = line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join, the one with the smallest doc_id stays.

    Texts without words are linked with nothing and stay. Rows that repeat the kept document all stay; a row without
    doc_id goes where it is linked with one that has an id. Another text under the id of a row that goes stays.
    """
    return jaccard_join.keep_first(docs, SHINGLE_WORDS, NUM, DEN)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go.

    It is decided per row: another text under the same id, or without id, stays. Items without words match nothing.
    """
    return winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by source at target weights, in random order.

    Rows alike in doc_id and text are drawn alike; a null source is a source. Adds rate, copy and mix_key.
    """
    return replication.replicate(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", unique_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmarks),
    ("mixing sources to target weights", mixed),
]

#: Two of the stages are no SQL: ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus that the stages make of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i + 1}")
    return docs
