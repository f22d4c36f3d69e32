"""The corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on every document that the one before it kept. All but the last return
the columns of ``documents``; each result is written as Parquet and reread as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, packing, quality, substring
from tessera.llm.common import Scratch


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose quality score is 0.7 or more; learns from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels.where(~quality.held_out()))
    return quality.score(docs, weights, threshold=0.7).where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest doc_id, of each group of near copies (five words, 0.8 or more)."""
    found = jaccard.near_duplicates(docs, similarity=0.8, ngram=5)
    others = found.where("not kept").select("doc_id").distinct()
    return docs.join(others, docs.doc_id.eqNullSafe(others.doc_id), "left_anti")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words that lie in a window of 50 words which a document with a smaller doc_id holds too."""
    return substring.dedup_rows(docs, window=50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [("quality", classify), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", pack)]

#: SQL cannot express a trained classifier, nor the tokenizer; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
