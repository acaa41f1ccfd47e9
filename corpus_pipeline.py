"""Corpus pipeline: language, exact copies, near copies, benchmark passages, packing."""

from __future__ import annotations

import os
import sys
from functools import partial

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexgrain.llm.bpe import loaded_bpe  # noqa: E402
from lexgrain.llm.decontaminate import drop_contaminated  # noqa: E402
from lexgrain.llm.exact_dedup import drop_exact_duplicates  # noqa: E402
from lexgrain.llm.language_id import keep_known_languages, train  # noqa: E402
from lexgrain.llm.near_dedup import drop_near_duplicates  # noqa: E402
from lexgrain.llm.packing import pack  # noqa: E402
from lexgrain.llm.queries import vocabulary_path  # noqa: E402
from lexgrain.session import new_scratch_path, ship_package  # noqa: E402

#: Language ID and tokens have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; texts without a letter and doubtful ones go."""
    ship_package(spark)
    return keep_known_languages(spark, docs, train(spark, docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    ship_package(spark)
    return drop_exact_duplicates(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id."""
    ship_package(spark)
    return drop_near_duplicates(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, or too little of one to count."""
    ship_package(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return drop_contaminated(spark, docs, items)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 1024 tokens."""
    ship_package(spark)
    return pack(docs, partial(loaded_bpe, vocabulary_path()), end_id=0)


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("benchmark", benchmark),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
