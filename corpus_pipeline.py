"""Documents to packed training sequences, stage by stage.

Each stage works on all rows that the one before kept. All but the last return the columns of
``documents``: documents that the classifier rejects go, one document of each group of near copies
(five words, 0.8) stays, and the mixture repeats or leaves out documents to meet its sources' targets.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowmill.llm import jaccard, mixing, packing, quality
from flowmill.llm.common import saved, table

ORACLE_SQL = None  # learned scores, a similarity join and a knapsack have no SQL


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality), ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mixture), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"stage-{i}")
    return docs
