"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import mixing, neardup, packing, quality, substrings
from keyloom.llm.common import remove, scratch_path, store


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (poor or toxic) go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8) the smallest id stays."""
    return neardup.keep_first(docs, shingle=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur in a document with a smaller id are cut out."""
    return substrings.strip(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their targets; a document drawn twice is there twice."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences: a row per piece, with its ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("substrings", without_repeats), ("mixing", mixed), ("packing", packed)]
#: The classifier's Newton steps and the tokenizer have no form in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's table is left to the caller to write."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch_path(spark, name)
        docs = store(out, name, path)
        if before:
            remove(spark, before)
        before = path
    raise AssertionError
