"""The corpus pipeline: quality, exact dedup, near dedup, mixing, packing.

``STAGES`` lists the stages as (name, function); a function takes
(spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of
``documents``; the last returns the packed pieces.  NULL texts count as empty
(they fail the quality rules), an empty table gives an empty result, and
columns beyond those of ``documents`` pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hpcstats.llm.chosen_path import near_dedup
from hpcstats.llm.mixing import mixed_documents
from hpcstats.llm.packing import pack_documents
from hpcstats.llm.perplexity import quality_filter
from hpcstats.llm.run_merge import exact_dedup
from hpcstats.llm.shared import documents, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the base rules and lie in their language's perplexity band."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the one with the largest doc_id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the one with the smallest doc_id."""
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it (none, once or twice)."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram jaccard join", near),
          ("mixing to target weights", mix), ("best-fit packing", pack)]

# Perplexity, tokens and random rounding are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
