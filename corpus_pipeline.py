"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

language ID -> exact dedup -> n-gram Jaccard join -> benchmark decontamination -> packing. Every stage works on all
documents its predecessor kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from ledgerline.llm.common import forget, mark, remove, shared_dir, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: no text, no letter in it, or unlike every language learned."""
    return language_id.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


#: Near duplicates here are on words of five and a similarity of 0.8 or more.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates stays, the one with the smallest id."""
    return jaccard_join.drop_near_duplicates(docs, NEAR_SHINGLE, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents of nothing else go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of all documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage left in the shared folder goes as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        began = mark()
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}")
        forget(spark, began)
        if i:
            remove(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(path)
    return docs


#: The last stage tokenises, which SQL cannot express; the tests hold the stages against brute force.
ORACLE_SQL = None
