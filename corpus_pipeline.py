"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared
folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fixatio.llm import line_dedup, mixing, neardup, packing, quality
from fixatio.llm.common import store, table
from fixatio.llm.digests import tokenizer_path

#: A learned classifier and similarity of texts have no SQL; tests compare with plain Python.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier learned from ``labels`` does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten documents or more."""
    return line_dedup.without_frequent_lines(docs)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a row per copy."""
    return mixing.repeated_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their places in sequences of 2048."""
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", line_deduplicated),
    ("near_dedup", near_deduplicated),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
